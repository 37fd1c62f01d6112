"""Filter interaction audit against plain loops over all orders."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from noteweave.llm.audit import mask_counts, order_effects, text_mask

DOCS = "doc_id long, text string, source string, mask string, hash int, first double, good string, n int"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(text: str) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    return out + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))


def plain_audit(docs, labels):
    """One document after the other goes through the filters of each order."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    rows = []
    for d, text, source in docs:
        again = d is not None and any(e is not None and e < d and (t or "") == (text or "") for e, t, _ in docs)
        rows.append((source or "", fails(text or "") + "E" * again, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f,
                ]
        for key, values in out.items():
            if key[0] == part:
                values[-1] = shapley[key[1][key[2] - 1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels, **more):
    table = spark.createDataFrame([(*d, "x", 1, 0.5, "y", 2) for d in docs], DOCS)
    judged = spark.createDataFrame([(*r, "z") for r in labels], LABELS)
    rows = order_effects(mask_counts(table, judged, **more)).collect()
    assert len(rows) == len({tuple(r)[:3] for r in rows})
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


def some_documents(n: int):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["ab", "Cd", "e#", "fgh", f"w{rnd.randint(0, 400)}"]) for _ in range(rnd.choice([3, 150, 260]))) for _ in range(n // 2)]
    texts += [" ".join(f"v{k}" for k in range(m)) for m in (199, 200, 201)] + ["a b " * 100, "a b " * 99 + "c d", "A" + "x" * 49, "A" + "x" * 48, "é" * 49 + "A"]
    return [(k, rnd.choice(texts), rnd.choice(["s", "t", "", None])) for k in range(n)]


@pytest.mark.parametrize("most", [1 << 29, 1])
def test_all_orders_equal_plain_loops(spark, most):
    docs = some_documents(120)
    docs += [(5, docs[7][1], "s"), (None, docs[7][1], "s"), (None, None, None), (200, None, "t"), (201, "", "t"), (201, "", "t"), (202, "x" * 300_000, "t"), docs[9]]
    labels = [(k, k % 2, k % 3 // 2) for k in range(0, 130, 2)] + [(k, 1, None) for k in range(0, 40, 3)] + [(None, 1, 1), (999, 1, 1), (4, None, 1)]
    assert audited(spark, docs, labels, most_counters=most) == plain_audit(docs, labels)


def test_one_large_group_of_copies(spark):
    docs = [(k, "the same text " * 80, "s") for k in range(900)] + [(k, f"text {k}", "t") for k in range(900, 1000)]
    got = audited(spark, docs, [(0, 1, 0), (1, 1, 1)])
    # Of 900 copies, all fail B and all but the first fail E.
    assert got["s", "EBACD", 1] == (1, 899, 0, 0, 1, 1, 899 * 60) and got["s", "BEACD", 2] == (0, 0, 899, 0, 0, 0, 899 * 60)
    assert got["t", "EBACD", 1][:2] == (100, 0)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "a", "s")], [])["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_text_mask_borders():
    assert [text_mask(t.encode()) for t in ("", "A" + "x" * 49, "A" + "x" * 48, "é" * 49 + "A", "a|b", "a\x0bb\x1cc")] == [1, 1, 5, 1, 9, 1]
