"""Input that every operator must bear."""

#: Rows with nulls in every column, empty and long texts, ties, repeats, and columns named like results.
ROWS = [
    (1, "One line. And more words here, so that it is a text of its own.\nOne line.", "en", "src1"),
    (2, "One line. And more words here, so that it is a text of its own.\nOne line.", "en", "src1"),
    (2, "One line. And more words here, so that it is a text of its own.\nOne line.", "en", "src1"),
    (3, "", "de", "src2"),
    (4, None, None, None),
    (None, "a text without an id, password=abcdef123", "fr", "nameless"),
    (None, None, None, "src7"),
    (5, "   \n\t\n \x0b", "es", ""),
    (6, "wörter " * 20_000, "de", "src2"),
    (7, "x" * 200_000, "en", "src3"),
    (8, "\x00\x01\x02 <p>odd</p> \ud7ff\U0001f600 İΣ", "en", "src3"),
]
