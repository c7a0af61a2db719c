"""Texts and pages that odd sources hold: very long runs of each kind of character, repeated fragments, deep nesting."""

SIZE = 300_000


def runs(size: int = SIZE) -> list[str]:
    units = ["a", "A", "1", " ", "\n", "\t \n", ".", "-", "@", "+", "é", "漢", "ab ", "a.", "1 ", "1.", "+1", "a@", "a@b.", "token=", "0f", "AKIA", "a:", "x://", "((", "Mr ", "Mr A ", "1-", "\u3000", "\x00", "😀", "'", '"']
    return [u * (size // len(u)) for u in units]


def texts(size: int = SIZE) -> list[str]:
    return [*runs(size), "a." * (size // 2) + "b x: y", "x " + " " * size, " " * size + "x", "token" + " " * size, "client_id" + " " * size + "= abcd"]


def pages(size: int = SIZE) -> list[str]:
    units = ["<", "<a ", "<a", "</p>", "<!", "<!--", "</", "<p>x", "<div>x", "<div>", "<script>", '<a "', "<a '", "<p x='\"", "&amp;", "&", "<li>a</ul>", "<a href=", "<div class=ad>x</div>"]
    return [u * (size // len(u)) for u in units] + ["<" + "a" * size, "<div>" * (size // 10) + "x" + "</p>" * (size // 10), "<p " + " class" * (size // 6) + ">x"]
