"""What Python workers hand back, without Spark."""

import pyarrow as pa

from tallyloom.sources import positioned


class Kept:
    def select(self, *_):
        return self

    where = drop = select

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_small_files_share_a_batch(monkeypatch):
    monkeypatch.setattr(positioned, "staged", lambda df, _: df)
    monkeypatch.setattr(positioned, "BATCH", 300)
    kept = Kept()
    positioned.items_from_bytes(kept, lambda content: [[(1, 2, 3, content.decode())]] if content else 1 / 0)
    files = pa.RecordBatch.from_pydict({"household_id": ["h"] * 500, "file_id": [str(n) for n in range(500)], "content": [b"" if n == 7 else b"x" for n in range(500)]})
    out = list(kept.run(iter([files.slice(0, 200), files.slice(200)])))
    assert [b.num_rows for b in out] == [300, 200]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["file_id"] for r in rows] == [str(n) for n in range(500)] and [r["file_id"] for r in rows if r["error"] == "ZeroDivisionError"] == ["7"]
