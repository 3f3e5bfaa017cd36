"""Rows of every awkward kind, for all corpus operators."""

PROSE = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))
EDGES = [
    (900001, None, "en"), (900002, "", "en"), (900003, " \t\n ", None), (900004, "one two three", "de"), (900005, "one two three", "de"),
    (900006, "Long text of words. " * 30_000, "en"), (900007, "ÀÉ straße ﬁn 漢字 ▁ é 😀 don't <|endoftext|> 12345", None),
    (900008, PROSE, "en"), (900009, PROSE + " changed", "en"), (900010, PROSE.upper(), "en"),
    (900011, "mail a.b@c.d.org or +44 20 7946 0958, card 4111 1111 1111 1111, host 10.0.0.255 and 300.1.1.1", "en"),
    (900012, "x" * 20_000, None), (900013, "12345 678 !!!", "en"), (None, "one two three", "en"),
]
#: Names that operators use inside, with other types than theirs.
CLASHING = "rep k1 k2 sig value key row h w n all base features component node label score pos id slots start ids".split()
