import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from parlance.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


pieces = st.lists(
    st.sampled_from(["a", "@", "b.c", ".", "1", "23", "255", " ", "-", "+", "(", ")", "4111111111111111", "é", "x@y.z", "%", "\n"]),
    max_size=25,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_base_spans_against_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def crf():
    return pii.fit_crf(pii.labelled_examples())


def test_model_adds_and_keeps(crf):
    texts = [
        "ring (415) 555-2671 now",
        "mail bob@mail.example.com or 10.0.0.1",
        "in 1999-2004, version 3.2.1 cost $1,200.50",
        None,
        "",
        "plain words only",
    ]
    found = pii.find_spans(texts, crf)
    assert pii.render(found[0][1]) == "phone:5:19" and not found[0][0]
    assert found[1][0] == found[1][1] and len(found[1][0]) == 2
    assert all(f == ([], []) for f in found[2:])


def test_runs_decode_like_the_whole_chain(crf):
    runs = [[pii.word_features("tel", "(415)", "555-2671"), pii.word_features("(415)", "555-2671", "now")], [pii.word_features("", "42", "")]]
    assert crf.decode(runs) == [crf.decode([r])[0] for r in runs]


def test_held_out_accuracy():
    rows = pii.labelled_examples()
    model = pii.fit_crf([r for k, r in enumerate(rows) if k % 5])
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    found = pii.find_spans([t for t, _ in held], model)
    # Cards that fail the check digit are not plausible and stay out by design.
    judged = [(bool(g), bool(f)) for (t, g), (_, f) in zip(held, found, strict=True) if not (g and g[0][0] == "card")]
    assert sum(a == b for a, b in judged) / len(judged) > 0.95


def test_table(table, crf):
    rows = [(1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (None, "1.2.3.4")]
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.base, r.spans) for r in pii.find_personal_data(table(rows), crf).collect()), key=str)
    assert got == sorted(
        [
            (1, 0, 0, "", ""),
            (2, 0, 0, "", ""),
            (3, 1, 0, "email:0:6", "email:0:6"),
            (3, 1, 0, "email:0:6", "email:0:6"),
            (None, 0, 1, "ip:0:7", "ip:0:7"),
        ],
        key=str,
    )
    assert pii.find_personal_data(table([]), crf).collect() == []


LONG = [
    "9" * 5_000_000,
    "1." * 2_500_000,
    "+1" * 2_500_000,
    "a@" * 2_500_000,
    " " * 5_000_000,
    "a" * 5_000_000,
    "+1" + "(" * 5_000_000,
    "@" * 5_000_000,
    "." * 5_000_000,
]


@pytest.mark.parametrize("text", LONG, ids=lambda t: t[:3])
def test_long_texts_of_one_class_take_linear_time(crf, text):
    began = time.time()
    base, spans = pii.find_spans([text + " x 1.2.3.4"], crf)[0]
    assert base[-1] == (len(text) + 3, 1, len(text) + 10) and time.time() - began < 60


def test_long_numbers_before_dots(crf):
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    assert pii.base_spans("0" * 5000 + "9.1.1.1") == [(0, 1, 5007)]
    assert pii.base_spans("1.2.3.4.5.6.7.256 1.2.3.4.5") == brute("1.2.3.4.5.6.7.256 1.2.3.4.5") == [(0, 1, 7), (18, 1, 25)]


def test_a_long_run_beside_short_ones(crf):
    """One table of numbers does not widen the batch of the others."""
    texts = ["1 " * 60_000 + "tel (415) 555-2671 end"] + ["call (415) 555-2671 now"] * 600
    found = pii.find_spans(texts, crf)
    assert all(pii.render(f) == "phone:5:19" for _, f in found[1:])


def test_neighbours_are_whole_words(crf):
    far = "number" + "x" * 100
    (run,) = pii._text_runs(f"{far}{' ' * 90}42{' ' * 90}{far} z")
    assert run == [(196, 198, far, "42", far)]
    assert pii.word_features("", "1" * 40, "") != pii.word_features("", "1" * 45, "")


def test_base_columns_on_the_corpus(spark, corpus, crf):
    got = {
        r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in pii.find_personal_data(
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet"),
            crf,
        ).collect()
    }
    want = {i: brute(t or "") for i, t in corpus.items()}
    assert got == {i: (*(sum(s[1] == k for s in b) for k in range(4)), pii.render(b)) for i, b in want.items()}
