import numpy as np
import pyarrow as pa

from ledgerloom.llm import common


def test_bytes_of_string_columns():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["ab", None, "", "ünï", "z"], kind)
        for part, want in ((column, ["ab", "", "", "ünï", "z"]), (column.slice(1, 3), ["", "", "ünï"])):
            data, at = common.utf8(part)
            assert [bytes(data[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_nulls_that_hold_bytes_are_empty():
    full = pa.array(["ab", "cd", "ef"])
    masked = pa.StringArray.from_buffers(3, full.buffers()[1], full.buffers()[2], pa.py_buffer(bytes([0b101])))
    data, at = common.utf8(masked)
    assert bytes(data) == b"abef" and at.tolist() == [0, 2, 2, 4]


def test_chunks_keep_rows_whole(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 10)
    texts = ["x" * n for n in (3, 3, 30, 0, 4, 6, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.arange(8))], ["text", "i"])
    got = list(common.chunks(iter([batch.slice(0, 0), batch]), "text"))
    assert [i for b, _, _ in got for i in b.column("i").to_pylist()] == list(range(8))
    assert all(len(d) == at[-1] and (len(d) <= 10 or b.num_rows == 1) for b, d, at in got)
