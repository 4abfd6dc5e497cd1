"""Plain versions of the operators, and documents with every odd case."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def odd_documents() -> list[tuple]:
    a = "the quick brown fox jumps over the lazy dog and then runs far away from the old mill by the river in spring"
    long = " ".join(f"word{k % 977} the" for k in range(9000))
    texts = [
        a, a, a.replace("quick", "slow"), a + " again", None, "", " \n\t ", "one", "One", "one two three", "one two three",
        "x " * 5000, long, long + " tail", "a\nb\na\nb\n\nb", "é ü ñ 🎉 " * 30, "mail me@example.com now. mail me@example.com now.",
        "+1 (017) 555-7713 and 4111 1111 1111 1111 and 10.0.0.256 and 10.0.0.255", "<|im_end|> \\ <\\| <|endoftext|> ▁", "a\x00b\x1cc\x85d",
        ("passage " * 60 + a) + " one ending", "other start " + ("passage " * 60 + a),
    ]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, "no id", None, None, None), (None, None, None, None, None)]


def documents(spark):
    """With columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents(), SCHEMA)
    return df.withColumns({"node": F.lit(1), "spans": F.lit("x"), "n": F.lit(2), "text_key": F.lit(3), "cell": F.lit(4)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            lists[x].append(k)
    overlap = Counter((a, b) for ks in lists.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), n in overlap.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least: dict[int, int | None] = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[k]:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(d, len(sets[k]), least.get(find(k), d) if sets[k] else d) for k, (d, _) in enumerate(rows)]


def removed(texts: list[str | None], length: int) -> list[tuple[int, int, int, bytes]]:
    """n_bytes, n_removed, n_spans and the kept bytes of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def without_passages(texts: list[str | None], words: int) -> list[str]:
    """Each text without the words covered by so many words that also start elsewhere, and the white space inside a removed run."""
    found = [list(WORD.finditer(t or "")) for t in texts]
    said = [[m[0] for m in ms] for ms in found]
    seen = Counter(tuple(w[k : k + words]) for w in said for k in range(len(w) - words + 1))
    out = []
    for t, ms, w in zip(texts, found, said, strict=True):
        gone = {j for k in range(len(w) - words + 1) if seen[tuple(w[k : k + words])] > 1 for j in range(k, k + words)}
        kept, at = "", 0
        for j, m in enumerate(ms):
            if j in gone:
                if j - 1 not in gone:
                    kept += t[at : m.start()]
                at = m.end()
        out.append(kept + (t or "")[at:])
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        n = int(x) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text: str | None) -> list[str]:
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p, good in PII for m in re.finditer(p, text or "") if good(m[0])]
