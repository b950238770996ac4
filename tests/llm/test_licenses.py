import random
import re

import pytest

from parlance.llm import licenses
from parlance.llm.licenses import Template

BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in BETWEEN.split(fold) if w]


def plain_names(text):
    w = words(text)
    return sorted(
        (i, t.label) for t in licenses.NAMES for i in range(len(w) - len(t.words) + 1) if w[i : i + len(t.words)] == t.words
    )


@pytest.fixture(scope="module")
def scan(table):
    def run(texts, *templates):
        rows = licenses.scan_licenses(table(list(enumerate(texts))), *templates).collect()
        return [r.places for r in sorted(rows, key=lambda r: r.doc_id)]

    return run


def test_names_stand_word_by_word(table):
    rng = random.Random(1)
    parts = ["GNU General Public License", "gnu general public", "license", "Apache-License", "apache", "CC", "by", "CC BY-NC 4", "MIT  License", "mit", "é", "İ", "K", "licensé", "x", "\n", "cc_by"]
    texts = [rng.choice([" ", ", ", "-"]).join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None]
    rows = licenses.summarise(licenses.scan_licenses(table(list(enumerate(texts))))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_names(texts[r.doc_id])
        starts = [i for i, _ in want]
        assert (r.n_words, r.n_base) == (len(words(texts[r.doc_id])), len(want))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in want})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.score == 1.0 if want else 0 <= r.score <= 1


def test_notices_with_changed_words(scan):
    notice = next(t for t in licenses.NOTICES if t.label == "mit" and t.threshold < 1).words
    whole, inserted, dropped = list(notice), notice[:9] + ["kindly"] + notice[9:], notice[:6] + notice[7:]
    half, twice = notice[: len(notice) // 2], notice + ["and", "then"] + notice
    found = scan([" ".join(["so", *w, "it", "ends"]) for w in (whole, inserted, dropped, half, twice)])
    label = [[(p.label, p.first) for p in places if p.label == "mit"] for places in found]
    assert label == [[("mit", 1)], [("mit", 1)], [("mit", 1)], [], [("mit", 1), ("mit", len(notice) + 3)]]
    assert found[0][0].coverage == 1 and 0.8 <= found[1][0].coverage < 1 and 0.8 <= found[2][0].coverage < 1


def test_a_place_is_not_hidden_by_what_surrounds_it(scan):
    t = Template("z", "a b c d e f g h i j", 0.8)
    around = " ".join(["a b x", "c d", "a b c d e f g h i j", "i j y i j", "e f"] * 3)
    assert [p.first for p in scan([around], (t,))[0]] == [5 + 22 * k for k in range(3)]


def test_longer_grams_and_short_templates(scan, table):
    t = Template("z", "one two three four five", 1.0)
    texts = ["One, two three four five six", "one two three", "one two three four fivE", "two three four five one two three four five"]
    assert [[p.first for p in places] for places in (licenses.scan_licenses(table(list(enumerate(texts))), (t,), gram=3).orderBy("doc_id").toPandas()["places"])] == [[0], [], [0], [4]]
    with pytest.raises(ValueError, match="at least 2 words"):
        scan(["x"], (Template("z", "alone", 1.0),))


def test_odd_rows(table, spark):
    rows = [(None, "MIT License"), (None, None), (1, "cc by"), (1, "cc by"), (2, ""), (3, "word"), (4, "cc by " * 200_000)]
    got = licenses.summarise(licenses.scan_licenses(table(rows))).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base) for r in got) == [
        ("1", 2, 1), ("1", 2, 1), ("2", 0, 0), ("3", 1, 0), ("4", 400_000, 200_000), ("None", 0, 0), ("None", 2, 1),
    ]
    assert licenses.scan_licenses(table([])).collect() == []


def test_no_python_on_the_way(table):
    plan = licenses.summarise(licenses.scan_licenses(table([(1, "x")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
