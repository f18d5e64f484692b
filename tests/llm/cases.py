from __future__ import annotations

#: Edge cases every operator must take: null id, null text, empty text, repeated rows, ties, a very long text.
EDGES = [
    (None, "some text without an id"), (1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, " \t\r\n"),
    (5, "word " * 40_000), (6, "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600 end"), (7, "x" * 100_000), (8, None),
]
