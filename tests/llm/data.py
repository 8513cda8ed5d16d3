"""Small tables with every awkward row, and brute-force answers."""

from __future__ import annotations

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
EXTRA = "size long, row long, key long, score double, target double, n long, id string, rid long, marks string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
NOTHING = (None,) * len(EXTRA.split(","))

WORDS = {
    "en": "the of and thing tion with other shall ever running house weather nothing always river stone".split(),
    "de": "der die und ung keit schön heiß über einer nicht straße müller wetter immer haus berg".split(),
}


def prose(r: random.Random, lang: str, n: int) -> str:
    words = [r.choice(WORDS[lang]) + r.choice(["", "", r.choice(WORDS[lang])]) for _ in range(n)]
    return " ".join(w.capitalize() if r.random() < 0.1 else w for w in words)


def rows() -> list[tuple]:
    """About fifty documents: prose, exact and near copies, shared passages, and odd rows."""
    r = random.Random(3)
    texts = [(prose(r, lang, r.choice([12, 60, 90, 150])), lang) for lang in ("en", "de") for _ in range(14)]
    passage = prose(r, "en", 70)
    texts += [(f"{prose(r, 'en', 20)} {passage} {prose(r, 'en', 25)}", "en") for _ in range(3)]
    texts += [texts[1], texts[1], texts[16]]
    near = texts[2][0].split()
    near[5] = "changed"
    texts += [(" ".join(near), "en"), (texts[3][0] + " one more", "en")]
    texts += [("word " * 400, "en"), ("a b c", "en"), ("", "en"), (" \n\t ", None), (None, "en"), ("1234 !!! 5678", "en"), ("ÀÉ 日本 　 x", None)]
    texts += [("Line one\nLine two\nLine one\n\n" + prose(r, "en", 60), "en"), (prose(r, "de", 4000), "de")]
    out = [(i, text, lang, None if i % 9 == 4 else f"s{i % 3}", None if text is None else len(text), *NOTHING) for i, (text, lang) in enumerate(texts)]
    return [*out, out[0], (None, texts[0][0], None, None, 1, *NOTHING)]


def words(text: str | None, lower: bool = False, kind: re.Pattern = SPACED) -> list[str]:
    return kind.findall((text or "").translate(LOWER) if lower else text or "")
