"""Very long texts, repeated rows and null ids in the classifier and the decontamination."""

import time

import numpy as np
import pytest
import zstandard

from parlance.llm import decontaminate as dc, quality

LONG = [c * 5_000_000 for c in (" ", "a", "7", "!", "é")] + ["a " * 2_500_000, "ab cd\n" * 800_000]


@pytest.mark.parametrize("text", LONG, ids=lambda t: repr(t[:3]))
def test_decontamination_of_long_texts(text):
    index = dc.Index([("x", "a b c d e f g h i j k"), ("y", "zz")], 10)
    began = time.time()
    ((n, hit, items),) = index.scan([text + " zz a b c d e f g h i j"])
    assert n == len(dc.words_of(text)) + 11 and hit == 11 and items == ["x", "y"] and time.time() - began < 40


@pytest.fixture(scope="module")
def fitted():
    good = [f"a quiet essay number {k} on rivers, hills and the people of the valley. " * 9 for k in range(40)]
    bad = [f"BUY {k} NOW!! cheap $$$ deal {k * 7} click >>> " * 9 for k in range(40)]
    return quality.fit([(t, 1) for t in good] + [(t, 0) for t in bad])


def plain_score(text, model):
    """The score by the definition: both compressors over pieces of 2,048 bytes, then the curve."""
    raw = (text or "").encode()
    total = []
    for d in (model.good, model.bad):
        n = 0
        for i in range(0, len(raw), 2048):
            own = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            n += len(own.compress(raw[i : i + 2048]))
        total.append(n)
    gap = total[1] - total[0]
    x = model.weights[0] + (model.weights[1] * gap / (len(raw) + 128) + model.weights[2] * gap / len(raw) if raw else 0)
    return 1 / (1 + np.exp(-x))


def test_scores_against_a_plain_version(table, fitted, corpus):
    rows = [(k, t) for k, t in list(corpus.items())[:60]] + [
        (None, "a river"),
        (None, "a river"),
        (7, None),
        (7, None),
        (7, ""),
        (8, "BUY NOW " * 600_000),
    ]
    got = sorted((str(r.doc_id), r.text or "", r.score) for r in quality.score_documents(table(rows), fitted).collect())
    want = sorted((str(i), t or "", plain_score(t, fitted)) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert len(quality.keep_good(table(rows), fitted).collect()) == sum(w[2] >= 0.5 for w in want)


@pytest.mark.parametrize("text", LONG, ids=lambda t: repr(t[:3]))
def test_scores_of_long_texts(fitted, text):
    assert 0 <= fitted.score([text])[0] <= 1


def test_length_alone_decides_nothing(fitted):
    """Texts whose compressed sizes do not differ score the same at every length."""
    same = quality.QualityModel(fitted.good, fitted.good, fitted.weights)
    assert len(set(same.score(["x", "y " * 50, "z " * 5000, None]).tolist())) == 1
