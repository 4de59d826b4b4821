"""Versions of a folder's state."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from passageloom.sources.versions import Conflict, Versions


def test_versions_are_published_once(spark, tmp_path):
    versions = Versions(spark, f"{tmp_path}/a")
    assert versions.current({"runs": []}) == (0, {"runs": []})
    versions.publish(1, {"runs": ["é"]})
    with pytest.raises(Conflict):
        versions.publish(1, {"runs": ["b"]})
    assert versions.current({}) == (1, {"runs": ["é"]})


def test_writers_do_not_overtake_each_other(spark, tmp_path):
    def add(_):
        Versions(spark, f"{tmp_path}/b").update({"n": 0}, lambda s: {"n": s["n"] + 1})

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(12)))
    assert Versions(spark, f"{tmp_path}/b").current({}) == (12, {"n": 12})


def test_old_versions_go(spark, tmp_path):
    versions = Versions(spark, f"{tmp_path}/c", keep=3)
    for i in range(1, 7):
        versions.publish(i, {"i": i})
    assert versions.numbers() == [4, 5, 6] and versions.read(4) == {"i": 4}
