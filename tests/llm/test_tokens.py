import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from parlance.llm import packing, token_counts as tc, tokens

ROWS = [
    (1, None),
    (2, ""),
    (3, "Hello world"),
    (3, "Hello world"),
    (4, "<|endoftext|> is ordinary"),
    (None, "no id"),
    (5, "long text here " * 3000),
    (6, "ü é \u00a0 漢字"),
]


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_counts_are_stitched_across_blocks(table, block):
    got = tc.count_tokens(tokens.flat_blocks(table(ROWS), block_tokens=block)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((i, len(tokens.encode(t))) for i, t in ROWS), key=str)
    assert tc.count_tokens(tokens.flat_blocks(table([]))).collect() == []


def test_token_files(spark, tmp_path):
    end = tokens.END_OF_DOCUMENT
    files = {"a.bin": [[1, 2, 3], [], [4] * 50], "b.bin": [[9]], "c.bin": []}
    for name, docs in files.items():
        np.array([x for d in docs for x in [*d, end]] + ([5, 6] if name == "a.bin" else []), "<u2").tofile(tmp_path / name)
    got = tc.count_tokens(tc.read_token_files(spark, f"file://{tmp_path}/*.bin", block_tokens=8)).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.ordinal):
        found.setdefault(r.file.rsplit("/")[-1], []).append(r.n_tokens)
    assert found == {"a.bin": [3, 0, 50], "b.bin": [1]}


def test_token_files_are_read_by_ranges(spark, tmp_path):
    """One row per range of a long file, no more tokens than a block in each, and an odd byte at the end left out."""
    ids = np.random.default_rng(1).integers(0, 1000, 100_003).astype("<u2")
    (tmp_path / "long name.bin").write_bytes(ids.tobytes() + b"x")
    df = tc.read_token_files(spark, f"file://{tmp_path}/*.bin", block_tokens=4096)
    rows = sorted(df.collect(), key=lambda r: r.block)
    assert [len(r.ids) for r in rows] == [8192] * 24 + [2 * (100_003 % 4096)]
    assert np.array_equal(np.frombuffer(b"".join(r.ids for r in rows), "<u2"), ids)
    assert "ReadSchema: struct<path:string,length:bigint>" in df._jdf.queryExecution().executedPlan().toString()  # no contents


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_decreasing(lengths):
    bins = packing.best_fit_decreasing(lengths, 30)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 30 for b in bins)
    free, count = [], 0  # the plain search gives as many bins
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(best := min(fits))
            free.append(best - n)
        else:
            free.append(30 - n)
            count += 1
    assert len(bins) == count


def test_packing_round_trip(table):
    packed = [r.asDict() for r in packing.pack(table(ROWS * 2), length=64, pool_tokens=500).collect()]
    back = sorted(((d, ids.tolist()) for d, ids in packing.unpack(packed).values()), key=str)
    assert back == sorted(((i, tokens.encode(t).tolist()) for i, t in ROWS * 2), key=str)
    for r in packed:
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64 and r["position_resets"] == cu[:-1] and len(r["ids"]) == 128
        pos = packing.positions(cu, 64)
        assert all(pos[lo] == 0 for lo in cu[:-1]) and pos.max() < 64
    assert packing.pack(table([])).collect() == []


@pytest.mark.parametrize("space", [" ", "\n", "\t \u00a0", "\u2003"])
@pytest.mark.parametrize("around", [("", ""), ("a", ""), ("a", "b"), (" x'", "'s ok"), ("7", "."), ("!", "\x1c!"), ("\x1c", "9")])
def test_long_runs_of_white_space_keep_their_ids(space, around):
    text = around[0] + (space * 70_000)[:70_000] + around[1]
    assert tokens.encode(text).tolist() == tokens.encoding().encode_ordinary(text)
    assert tokens.encode(text * 3 + "z").tolist() == tokens.encoding().encode_ordinary(text * 3 + "z")


@pytest.mark.parametrize("c", [" ", "a", "7", "!", "\u6f22", "\n"])
def test_long_texts_of_one_class(c):
    """Five million characters, which the pattern's engine alone does not survive where they are white space."""
    ids = tokens.encode(c * 5_000_000 + "end")
    assert tokens.encoding().decode(ids.tolist()) == c * 5_000_000 + "end"


def test_vocabulary_decides_end_and_width(tmp_path):
    import base64

    assert tokens.end_of_document() == tokens.END_OF_DOCUMENT and tokens.id_type() == np.dtype("<u2")
    wide = tmp_path / "wide.tiktoken"
    words = [bytes([k]) for k in range(256)] + [b"%06d" % k for k in range(70_000)]
    wide.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % k for k, w in enumerate(words)))
    assert tokens.end_of_document(str(wide)) == 70_256 and tokens.id_type(str(wide)) == np.dtype("<u4")
