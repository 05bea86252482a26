"""Languages of many scripts: letters beyond the alphabet still tell scripts apart."""

import random

from treedex.llm import language


def test_scripts():
    rng = random.Random(3)
    first = {"ru": 0x430, "el": 0x3B1, "he": 0x5D0, "ar": 0x628, "hi": 0x915, "th": 0xE01, "ka": 0x10D0, "hy": 0x561, "ko": 0xAC00, "zh": 0x4E00, "am": 0x1200, "en": 0x61}
    wide = {"ko": 9000, "zh": 18000}

    def text(x):
        return " ".join("".join(chr(first[x] + rng.randrange(wide.get(x, 22))) for _ in range(rng.randint(2, 8))) for _ in range(40))

    langs = [x for x in first for _ in range(40)]
    m = language.Model([text(x) for x in langs], langs)
    asked = [x for x in first for _ in range(25)]
    got = m.score([text(x) for x in asked])[0]
    assert sum(a == b for a, b in zip(asked, got, strict=True)) >= 0.95 * len(asked)


def test_own_words_tell_languages_of_one_script():
    rng = random.Random(5)
    words = {x: ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randint(2, 9))) for _ in range(150)] for x in ("ru", "bg", "sr")}
    text = lambda x: " ".join(rng.choice(words[x]) for _ in range(50))
    langs = [x for x in words for _ in range(60)]
    m = language.Model([text(x) for x in langs], langs)
    asked = [x for x in words for _ in range(40)]
    assert sum(a == b for a, b in zip(asked, m.score([text(x) for x in asked])[0], strict=True)) >= 0.95 * len(asked)
