"""Rows with every oddity that an operator must take: (id, text)."""

ODD = [
    (None, None), (None, "id is null"), (1, None), (2, ""), (3, " \t\n "), (4, "Hello World hello world"), (5, "hello world HELLO world"),
    (6, "word " * 20_000), (7, "x" * 60_000), (8, "É é ÀB naïve 日本語 текст 🎉 é"), (8, "the same id, another text"), (9, "repeated row of words that is here twice over and over again my friend"),
    (9, "repeated row of words that is here twice over and over again my friend"), (10, "12345 !!! ..."), (11, "<|endoftext|> in a text"), (12, "a b c \x00 d\r\n e"),
]
