"""Rows that every operator on documents must take."""

#: Texts that every operator on documents must take: NULL, empty, white space, one word, a NULL
#: id, repeated rows, one id with two texts, other alphabets, long runs of one character.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (None, "no id " * 30),
    (5, "twice the same row " * 12),
    (5, "twice the same row " * 12),
    (6, "one id first text " * 12),
    (6, "one id second text " * 12),
    (7, "née Übergröße 東京 \U0001f600 " * 9),
    (8, "a" * 3000),
    (9, "7" * 2000 + " " + "1 " * 500),
    (10, "  \x1c\x00 [INST] </s> <|endoftext|> \x85 " * 4),
]
