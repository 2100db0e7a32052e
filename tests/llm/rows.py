"""Rows that every operator on documents must take."""

#: Nulls, empty and blank texts, a long text, ties, repeated rows.
ODD_ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (None, "a text without an id", "b"), (None, None, None),
    (5, "word " * 30_000, "c"), (6, "same text here for all of us", "c"), (6, "same text here for all of us", "c"), (7, "same text here for all of us", "a"),
    (8, "é漢字🙂 ▁ mark\x00null <|endoftext|> <s>", "a"), (9, "x" * 40_000, "a"), (6, "another text under the same id", "c"),
]
