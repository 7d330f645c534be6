import threading

import pytest

from portlight.operators import merge
from portlight.sources import files


def rows_of(spark, folder):
    return sorted(tuple(r) for r in files.read_version(spark, folder).collect())


def frame(spark, rows, columns="k int, v string"):
    return spark.createDataFrame(rows, columns)


def test_any_earlier_label_counts(spark, tmp_path):
    folder = str(tmp_path / "t")
    for label, value in (("a", "1"), ("b", "2"), ("a", "1"), ("b", "2")):
        merge.merge_into(spark, folder, frame(spark, [(1, value)]), ["k"], label)
    assert rows_of(spark, folder) == [(1, "2")] and [x["label"] for x in files.versions(spark, folder)] == ["a", "b"]
    assert [tuple(r) for r in files.read_version(spark, folder, 1).collect()] == [(1, "1")]
    with pytest.raises(ValueError, match="no version 9"):
        files.read_version(spark, folder, 9)


def test_repeated_keys_and_new_columns(spark, tmp_path):
    folder = str(tmp_path / "t")
    merge.merge_into(spark, folder, frame(spark, [(1, "b"), (1, "a"), (2, None)]), ["k"], "1")
    assert rows_of(spark, folder) == [(1, "a"), (2, None)]
    merge.merge_into(spark, folder, frame(spark, [(2, "c", 5), (2, "z", 4), (3, "d", 1)], "k int, v string, at int"), ["k"], "2", latest="at")
    assert sorted(rows_of(spark, folder), key=str) == [(1, "a", None), (2, "c", 5), (3, "d", 1)]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    folder, wrong = str(tmp_path / "t"), []

    def write(i):
        try:
            merge.merge_into(spark, folder, frame(spark, [(i, f"w{i}"), (99, f"w{i}")]), ["k"], f"w{i}")
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not wrong and [x["version"] for x in files.versions(spark, folder)] == [1, 2, 3, 4]
    got = dict(rows_of(spark, folder))
    assert {k: got[k] for k in range(4)} == {i: f"w{i}" for i in range(4)}
    assert got[99] == files.versions(spark, folder)[-1]["label"]


def test_a_version_has_one_writer(spark, tmp_path):
    folder = str(tmp_path / "t")
    files.write_version(frame(spark, [(1, "a")]), folder, 1, "first", {"n": 1})
    with pytest.raises(files.LostRace):
        files.write_version(frame(spark, [(1, "b")]), folder, 1, "second")
    assert rows_of(spark, folder) == [(1, "a")] and files.versions(spark, folder)[0]["info"] == {"n": 1}
    assert not list((tmp_path / "t" / "_log").glob("*.json.*"))


def test_a_file_is_created_once(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if files.create_once(spark, f"{tmp_path}/x/f", str(i)) else None) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and files.read_text(spark, f"{tmp_path}/x/f") == str(won[0])


def test_single_flight(spark, tmp_path):
    folder = str(tmp_path)
    with files.single_flight(spark, folder, "sync"):
        with pytest.raises(files.AlreadyRunning), files.single_flight(spark, folder, "sync"):
            pass
        with files.single_flight(spark, folder, "other"):
            pass
    with pytest.raises(KeyError), files.single_flight(spark, folder, "sync"):
        raise KeyError
    with files.single_flight(spark, folder, "sync"):  # given back, also after an error
        pass
    files.create_once(spark, f"{folder}/_locks/dead", '{"owner": "x", "since": 1}')
    with files.single_flight(spark, folder, "dead"), pytest.raises(files.AlreadyRunning), files.single_flight(spark, folder, "dead"):
        pass
