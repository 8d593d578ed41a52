"""Rows that every operator must bear, and a sorted view of results."""

LONG = "lorem ipsum dolor sit amet " * 8000
AWKWARD = [(1, "one two three", "a"), (2, None, "b"), (3, "", None), (4, "one two three", "a"), (4, "one two three", "a"), (None, "no id here", None),
           (None, None, "b"), (5, " \t\n\r\x0b\x0c ", "a"), (6, "word", "c"), (7, LONG, "c"), (8, "é日本 \x1c\x85\xa0 <|endoftext|> it's 123", "b"), (9, "x" * 30000, "b"),
           (10, "MIT License and the Apache License, GNU General Public License", "a")]


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
