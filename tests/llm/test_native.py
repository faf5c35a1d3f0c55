"""op7 fingerprints and op9 shards."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from samples import ODD, prose
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints, shards


def test_fingerprints_follow_the_edited_text(make):
    rows = [(10 * i, " ".join(prose(i, 40 + i))) for i in range(30)] + [(5, "kan"), (15, ""), (25, "ab"), (35, "abcdefgh" * 9)]
    got = {r.doc_id: r for r in fingerprints.fingerprinted_documents(make(rows), blocks=7).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        tail = len(text) // 4
        edited = text[:len(text) - tail] + following[:tail]
        row = got[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        if len(text) > 100:
            assert row.near_edited > 0.3 > row.near_next
        if edited == text:
            assert row.fingerprint == row.edited_fingerprint and row.near_edited == 1


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_next_row_for_any_cut(make, blocks):
    rows = [(i * i % 97, f"t{i}") for i in range(60)]
    got = fingerprints.with_next(make(rows).select("doc_id", "text"), "doc_id", ["text"], blocks).collect()
    ordered = sorted(rows)
    want = sorted((*r, ordered[(i + 1) % len(ordered)][1]) for i, r in enumerate(ordered))
    assert sorted((r.doc_id, r.text, r.next_text) for r in got) == want


def test_sketches_merge_and_estimate(spark):
    a, b = prose(1, 3000), prose(1, 3000)[:2000] + prose(2, 1000)
    df = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[:1500]), " ".join(a[1496:]))], "a string, b string, x string, y string")
    s = {c: fingerprints.sketch(F.col(c)) for c in "abxy"}
    row = df.select(
        fingerprints.resemblance(s["a"], s["b"]).alias("r"), fingerprints.containment(s["a"], s["b"]).alias("c"),
        fingerprints.distinct_shingles(s["a"]).alias("n"),
        F.size(F.array_except(s["a"], fingerprints.merged(s["x"], s["y"]))).alias("lost")).first()

    def sh(w):
        return {tuple(w[max(0, i - 4):i + 1]) for i in range(len(w))}

    A, B = sh(a), sh(b)
    assert abs(row.r - len(A & B) / len(A | B)) < 0.15
    assert abs(row.c - len(A & B) / len(A)) < 0.2
    assert abs(row.n / len(A) - 1) < 0.3
    assert row.lost == 0


def test_fingerprints_of_odd_rows(make):
    got = fingerprints.fingerprinted_documents(make(ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == "" and by_id[1].n_chars == 0 and by_id[1].near_edited == 1
    assert by_id[7].fingerprint != "" and fingerprints.fingerprinted_documents(make([])).count() == 0


def test_shards_are_even_and_places_gapless(make):
    rows = [(i, "y" * (i * 7919 % 500)) for i in range(3000)] + ODD
    got = shards.sharded_documents(make(rows)).collect()
    assert len(got) == len(rows)
    sizes, places = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert sorted(places) == list(range(8))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sizes.values()) - min(sizes.values()) < 600
    null = next(r for r in got if r.doc_id == 1 and r.size == 1)
    assert null.text_crc32 == 0
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    assert shards.sharded_documents(make([])).count() == 0


def test_a_rebalance_moves_little_and_growth_fills_the_new_shard(spark):
    loads = spark.createDataFrame([(s, 100 + s * 37 % 50, 1) for s in range(400)], "slot int, bytes long, rows long")
    first = shards.rebalanced(shards.first_map(loads), loads)
    one = {r.slot: r for r in first.collect()}
    again = {r.slot: r for r in shards.rebalanced(first, loads).collect()}
    assert {r.version for r in again.values()} == {3}
    assert sum(one[s].shard != again[s].shard for s in one) <= 8
    grown = {r.slot: r.shard for r in shards.rebalanced(first, loads, 9).collect()}
    moved = {s for s in one if one[s].shard != grown[s]}
    byte = {r.slot: r.bytes for r in loads.collect()}
    assert sum(byte[s] for s in moved) < 1.1 * sum(byte.values()) / 9
    total = [sum(byte[s] for s in grown if grown[s] == k) for k in range(9)]
    assert max(total) - min(total) < 150
    shrunk = {r.slot: r.shard for r in shards.rebalanced(first, loads, 7).collect()}
    assert set(shrunk.values()) == set(range(7))


def spread(rows):
    total = {}
    for r in rows:
        total[r.shard] = total.get(r.shard, 0) + r.size
    return total


def test_shards_are_even_with_missing_and_repeated_ids(make):
    text = "kan lor mist tul"
    rows = [(i, f"{text} {i:05d}") for i in range(1500)] + [(None, text + " 00000")] * 1500 + [(7, text + " 00001")] * 1500
    got = shards.sharded_documents(make(rows)).collect()
    assert len(got) == len(rows)
    sizes = spread(got)
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values())
    for shard in range(8):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))


def test_the_map_is_stored_and_edited(spark, make, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, f"kan lor {i}" * (1 + i % 7)) for i in range(400)]
    first = shards.sharded_documents(make(rows), slots=64, map_path=path).collect()
    assert {r.map_version for r in first} == {2}
    again = shards.sharded_documents(make(rows), slots=64, map_path=path).collect()
    assert {r.map_version for r in again} == {3}
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.shard) for r in first}
    grown = shards.sharded_documents(make(rows + [(i, "word " * 40) for i in range(1000, 1060)]), slots=64, map_path=path).collect()
    before, after = ({r.vslot: r.shard for r in x} for x in (again, grown))
    assert sum(after[s] == before[s] for s in before) > len(before) / 2
    stored = spark.read.parquet(path)
    assert sorted(r.version for r in stored.select("version").distinct().collect()) == [1, 2, 3, 4]
    assert stored.groupBy("version", "slot").count().where("count > 1").count() == 0
