"""Odd rows that every operator of the folder meets."""

NEAR = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen " \
       "eighteen nineteen twenty twentyone twentytwo twentythree twentyfour twentyfive twentysix twentyseven"
ROWS = [
    (1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (4, "a b c"), (5, NEAR + "."), (6, NEAR + " more."), (7, NEAR.upper() + "."),
    (8, "Tiny."), (9, "a b c"), (10, "x " * 6000 + "end."), (11, "le été ﬁn 漢字 İ <|endoftext|> don't 12,5 km"),
    (12, "\n".join(f"Line {k} goes on for a while, as lines do." for k in range(300))), (None, "no id here, but words."),
    (6, NEAR + " more."), (13, "a b c d e a b c d e a b c d e"),
]
