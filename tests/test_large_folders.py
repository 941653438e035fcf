"""A folder is handed on as it is listed, and what cannot be entered is left out of large trees as of small ones."""

import os

import pyarrow as pa
import pytest

from strataweave.sources import files as src


@pytest.fixture
def root(tmp_path):
    (tmp_path / "triggers").mkdir()
    for i in range(25):
        (tmp_path / f"triggers/T{i:02d}.trigger").write_text(f"trigger T{i:02d} on O (before insert) {{}}")
    os.symlink("self.cls", tmp_path / "triggers/self.cls")  # to itself
    os.symlink("nothing", tmp_path / "triggers/gone.trigger")
    return str(tmp_path)


def test_names_of_one_folder_are_handed_on_in_pieces(root, monkeypatch):
    monkeypatch.setattr(src, "NAMES_A_BATCH", 10)
    listed, most = [], 0
    scandir = os.scandir

    class Counted:
        def __init__(self, folder):
            self.entries, self.seen = scandir(folder), 0
            looks.append(self)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.entries.close()

        def __iter__(self):
            for e in self.entries:
                self.seen += 1
                yield e

    looks = []
    monkeypatch.setattr(os, "scandir", Counted)
    for batch in src._names(iter([pa.RecordBatch.from_pydict({"path": [f"{root}/triggers"]})]), False):
        most = max(most, looks[0].seen - len(listed))
        listed += batch.column("path").to_pylist()
    assert most <= 10 + 2 and looks[0].seen == 27  # no further than the batch, but for the two links
    assert sorted(os.path.basename(p) for p in listed) == [f"T{i:02d}.trigger" for i in range(25)]


def test_links_to_themselves_are_left_out(spark, root, monkeypatch):
    def names():
        tree = src.walk(spark, root)
        return tree.listing is not None, [r.filename for k in ("apex", "triggers") for r in src.scan(spark, tree, k).collect()]

    large, small = [], names()
    monkeypatch.setattr(src, "FEW_ENTRIES", 3)
    large = names()
    assert small == (False, large[1]) and large == (True, [f"T{i:02d}.trigger" for i in range(25)])
