"""Odd documents that every operator and stage must take, and their plain readings."""

from __future__ import annotations

import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words string, kept boolean, rid int, counts int, "
          "_text string, _places int, size string, spans int, items string, u double, class_id string, batch int, `doc.x y` string")


def words(text: str | None) -> list[str]:
    return SPACE.findall(text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    common = "the of and to in is that it for as with on by at".split()
    out = [r.choice(common) if r.random() < 0.3 else "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n)]
    return "\n".join(" ".join(out[i: i + 12]) + "." for i in range(0, n, 12))


def documents() -> list[tuple]:
    shared = prose(99, 60)
    base = prose(1, 200)
    near = base.replace(base.split()[100], "changed")
    texts = {
        1: base, 2: base, 3: near, 4: None, 5: "", 6: " \n\t", 7: "one", 8: "ONE", 9: prose(2) + "\n" + shared, 10: prose(3) + "\n" + shared,
        11: "a " * 500, 12: "\n".join(["the same line again"] * 60), 13: prose(4, 30_000), 14: "é ü 日本 " * 40, 15: "q" * 3000,
        16: base.upper(), 17: "x #*$%&|<> y\r\n\r\nz", 18: prose(5) + "\n" + prose(5),
    }
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    rows += [rows[0], rows[0], (None, base, None, None, None), (None, None, None, None, None), (9, prose(7), "de", "s1", 3)]
    return [(*r, "w", True, 1, 2, "t", 3, "s", 4, "i", 0.5, "c", 6, "d") for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def pairs(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
