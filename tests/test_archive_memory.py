"""Archives are written and read in bounded memory, whatever their lines."""

import io
import tracemalloc
import zipfile
from types import SimpleNamespace

import pyarrow as pa
import pytest

from newslens import adapter
from newslens.sources import archives


@pytest.fixture
def packed(monkeypatch):
    monkeypatch.setattr(adapter, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 7)))
    return lambda batches: [(b["path"][0].as_py(), b["content"][0].as_py()) for b in adapter._pack(batches)]


def _batches(n, size, width):
    for start in range(0, n, size):
        lines = [f"{i}\t".ljust(width, "x") for i in range(start, min(n, start + size))]
        yield pa.RecordBatch.from_pydict({"value": lines})


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_archives_end_at_their_number_of_lines(packed, monkeypatch):
    monkeypatch.setattr(adapter, "LINES_PER_ARCHIVE", 1500)
    found = packed(_batches(4000, 1700, 12))
    assert [name for name, _ in found] == [f"000007-{i:06d}.export.CSV.zip" for i in range(3)]
    texts = []
    for name, content in found:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            assert archive.namelist() == [name.removesuffix(".zip")]
            texts.append(archive.read(archive.namelist()[0]).decode())
    assert [t.count("\n") for t in texts] == [1500, 1500, 1000]
    assert "".join(texts) == "".join(f"{line}\n" for b in _batches(4000, 1700, 12) for line in b["value"].to_pylist())


def test_archives_are_written_without_holding_their_lines(packed):
    assert _peak(lambda: packed(_batches(40_000, 1000, 1000))) < 15 << 20


def test_archives_are_read_without_holding_their_lines():
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as target:
        target.writestr("a.CSV", "".join(f"{i}\t".ljust(10_000, "x") + "\n" for i in range(4000)))
    batch = pa.RecordBatch.from_pydict({"content": [content.getvalue()]})
    seen = []

    def read():
        for lines in archives._member_lines([batch]):
            seen.append(lines.num_rows)

    assert _peak(read) < 15 << 20
    assert sum(seen) == 4000
