"""Download links of crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a registry download looks like.
DOWNLOAD_EXTENSION = ".zip"
PREFERRED_TERMS = ("padron", "reduc")

#: An anchor: its address and everything up to its end, or to the next anchor.
_ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>((?:(?!</a>|<a\s).)*+)"""
#: Character references that occur in addresses.
REFERENCES = {"&amp;": "&", "&#38;": "&", "&#x26;": "&", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">"}


def _decoded(text: Column) -> Column:
    """Text with the character references of addresses; the ampersand comes last, as its result may look like one."""
    for reference, character in sorted(REFERENCES.items(), key=lambda r: r[1] == "&"):
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute address of a link on the page ``base``."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    page = F.regexp_replace(base, "[?#].*$", "")
    path = F.substring(page, F.length(origin) + 1, F.length(page))
    folder = F.when(path.contains("/"), F.regexp_extract(path, "^(.*/)", 1)).otherwise("/")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, _plain_path(link)))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#") | (link == ""), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(origin, _plain_path(F.concat(folder, link))))
    )


def _plain_path(path: Column) -> Column:
    """Path with ``.`` and ``..`` steps taken."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.array_append(done, part))

    split = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/", -1)
    walked = F.aggregate(F.slice(split, 2, F.size(split)), F.array().cast("array<string>"), step)
    plain = F.concat(F.lit("/"), F.array_join(walked, "/"))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), plain).otherwise(path)


def rank_download_links(
    pages: DataFrame,
    *,
    contains: str = DOWNLOAD_EXTENSION,
    preferred: tuple[str, ...] = PREFERRED_TERMS,
) -> DataFrame:
    """Links of each page that contain a text in address or name, preferred ones first, then in page order.

    All of it happens inside the row of a page: no shuffle, whatever the number of links. Without
    a matching link the page text is searched for names that end in ``contains``.
    """
    base, wanted = F.col("url"), F.lit(contains.lower())
    anchors = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(2)).alias("text"),
    )
    named = F.filter(
        F.transform(
            anchors,
            lambda a: F.struct(
                resolve_url(base, F.trim(_decoded(a["href"]))).alias("link"),
                F.lower(F.regexp_replace(a["text"], "<[^>]*>", " ")).alias("text"),
            ),
        ),
        lambda a: F.contains(F.lower(a["link"]), wanted) | F.contains(a["text"], wanted),
    )
    found = F.transform(named, lambda a: a["link"])
    # Addresses outside anchors: words of the page, cut where the text that is looked for ends.
    words = F.split("html", r"[\s\"'<>()=]+")
    loose = F.transform(
        F.filter(words, lambda w: F.instr(F.lower(w), contains.lower()) > 1),
        lambda w: resolve_url(base, _decoded(F.left(w, F.instr(F.lower(w), contains.lower()) + (len(contains) - 1)))),
    )
    links = F.when(F.size(found) > 0, found).otherwise(loose)

    def is_preferred(link: Column) -> Column:
        lowered, hit = F.lower(link), F.lit(False)
        for term in preferred:
            hit = hit | F.contains(lowered, F.lit(term))
        return hit

    ranked = F.concat(F.filter("links", is_preferred), F.filter("links", lambda h: ~is_preferred(h)))
    return (
        pages.select("page_id", links.alias("links"))
        .select("page_id", F.posexplode(ranked).alias("position", "link"))
        .select("page_id", (F.col("position") + 1).alias("link_rank"), "link", is_preferred(F.col("link")).alias("preferred"))
    )


def best_download_link(pages: DataFrame, **options) -> DataFrame:
    return rank_download_links(pages, **options).where(F.col("link_rank") == 1).drop("link_rank")
