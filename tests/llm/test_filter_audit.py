import random
import re
from collections import Counter
from itertools import permutations

import pytest

from parlance.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mask(text):
    w = WORD.findall(text)
    caps = sum("A" <= c <= "Z" for c in text)
    fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * caps > 5 * len(text), any(c in "#$%&*|" for c in text))
    return [f for f, x in zip("ABCD", fails, strict=True) if x]


def plain_audit(rows, labels):
    """Every order applied to every row, one after the other."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    judged = []
    for d, text, source in rows:
        fails = set(plain_mask(text or ""))
        if d is not None and d > least[text or ""]:
            fails.add("E")
        judged.append((source or "", fails, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in permutations("ABCDE"):
            kept = own
            for step, f in enumerate(order, 1):
                gone = [j for j in kept if f in j[1]]
                kept = [j for j in kept if f not in j[1]]
                all_fail = sum(f in j[1] for j in own)
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), all_fail - len(gone), sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(documents, labels, **options):
    rows = filter_audit.audit_filters(documents, labels, **options).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def marks(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["aa", "Bb", "ccé", "d|", "EEE"]) + str(rng.randrange(k)) for _ in range(n)) for n, k in [(5, 9), (60, 9), (60, 999), (80, 40)] * 5]
    rows = [(rng.randrange(150), rng.choice(texts), rng.choice(["x", "y", None, ""])) for _ in range(300)]
    return rows + [(None, texts[0], "x"), (None, texts[0], "x"), (7, None, "y"), (3, "", "y"), (3, "", "y"), (1, " \t\n", "x")]


def test_against_every_order_applied(table, marks):
    rows = corpus()
    labels = [(k % 160, k % 3 % 2, int(k % 5 == 0)) for k in range(200)] + [(None, 1, 1), (4, None, None)]
    assert audited(table(rows).repartition(5), marks(labels)) == plain_audit(rows, labels)


def test_full_texts_decide_where_fingerprints_collide(table, marks):
    rows = corpus(4)
    want = plain_audit(rows, [])
    for fingerprint in (lambda data: 0, lambda data: len(data) % 3):
        assert audited(table(rows).repartition(3), marks([]), fingerprint=fingerprint, partitions=4) == want


def test_tasks_that_send_early(table, marks, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", 1000)
    chains = filter_audit.Chains()
    sent = [x for k in range(50) for x in chains.add(k % 5, b"t" * 300, lambda: 1, 50 - k, {"p": 1})]
    assert len(sent) == 45 and all(mask & filter_audit._COPY for _, _, mask, _ in sent)
    rows = corpus(5)
    routed = list(filter_audit._send(lambda data: 0)((d, s or "", t or "") for d, t, s in rows))
    assert Counter(n for _, r in routed for n in [isinstance(r, list)])[True] > 20
    got = Counter()
    for d, part, mask, n in filter_audit._judge(iter(routed)):
        got[d, part, bool(mask & filter_audit._COPY)] += n
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    assert got == Counter((d, s or "", d is not None and d > least[t or ""]) for d, t, s in rows)


def test_many_copies_and_long_texts(table, marks):
    rows = [(k, "same text", "hot") for k in range(2000)] + [(5000, "word " * 400_000, "long"), (5001, "x" * 2_000_000, "long")]
    got = audited(table(rows).repartition(9), marks([(0, 1, 0), (9, 1, 1)]))
    assert got["hot", "EABCD", 1][:6] == (1, 1999, 0, 0, 1, 1) and got["hot", "AEBCD", 2][2] == 1999
    assert got["long", "ABCDE", 1][:2] == (1, 1) and got["long", "ABCDE", 2][1] == 1


def test_empty_table(table, marks):
    assert audited(table([]), marks([])) == {}
