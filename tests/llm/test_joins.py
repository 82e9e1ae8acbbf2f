import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from samples import EDGE, components, copies, corpus
from unitwise.llm import line_dedup as L
from unitwise.llm import ngram_join as J
from unitwise.llm import regions as R
from unitwise.llm.components import connected_components
from unitwise.session import stage_by

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = [grams(t) for _, t in rows]
    pairs = [(a, b) for a, b in combinations(range(len(rows)), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    links = Counter(k for p in pairs for k in p)
    return {(rows[k][0], len(sets[k]), rows[c][0], links[k]) for k, c in enumerate(components(len(rows), pairs))}


@pytest.mark.parametrize("seed,region,levels,counted", [(1, 2048, 3, 512), (2, 4, 2, 3), (3, 3, 1, 2), (4, 2, 0, 4)])
def test_join_finds_the_components_and_links_of_all_pairs(spark, seed, region, levels, counted):
    rows = copies(seed, groups=8, size=12)
    found = J.ngram_join(corpus(spark, rows), region, levels, counted).collect()
    assert {tuple(r) for r in found} == expected(rows)


def test_regions_are_cut_by_classes_and_by_bytes(spark, monkeypatch):
    """Long chains, whose ends do not link, divide by pivots; so do few classes of many hashes."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k:4 * k + 80])) for k in range(70)]
    rows += [(100 + k, " ".join([f"v{j}" for j in range(200)] + [f"x{k}"])) for k in range(30)]
    divided = []
    divide = R._divide
    monkeypatch.setattr(R, "_divide", lambda large, *rest: divided.append(large.count()) or divide(large, *rest))
    for counted, keys in ((8, R.KEYS), (512, 700)):
        monkeypatch.setattr(R, "KEYS", keys)
        divided.clear()
        found = J.ngram_join(corpus(spark, rows), 2048, 3, counted).collect()
        assert {tuple(r) for r in found} == expected(rows)
        assert divided and divided[0] >= 100


def test_least_shared_holds_for_every_size():
    for a in range(1, 400):
        for b in range(a, a * 4 // 3 + 1):
            both = -(-75 * (a + b) // 175)
            if both <= a:
                behind = max(-(-70 * a // 100) - 1, -(-70 * b // 100) - 1)
                assert both - behind >= J.least_shared(a) and both - behind >= J.least_shared(b)


def test_join_edge_cases(spark):
    found = {r.doc_id: r for r in J.ngram_join(corpus(spark, EDGE)).collect()}
    assert found[1].n_shingles == 0 and found[1].component_id == 1
    assert found[2].component_id == 2 and found[3].component_id == 3
    assert found[5].component_id == 4 and found[None].component_id == 4
    assert found[8].component_id == 7
    assert [found[k].n_links for k in (1, 2, 4, 5, None, 7, 8, 9)] == [0, 0, 3, 3, 3, 1, 1, 0]
    assert J.ngram_join(corpus(spark, EDGE)).count() == len(EDGE)
    assert J.ngram_join(corpus(spark, [])).count() == 0
    kept = J.drop_near_copies(corpus(spark, EDGE))
    assert kept.columns == corpus(spark, EDGE).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 9, 10]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def runs(line):
    return {line[k:k + L.CHARS] for k in range(max(1, len(line) - L.CHARS + 1))}


def expected_lines(rows):
    places = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = [runs(x) for _, _, x in places]
    pairs = [(a, b) for a, b in combinations(range(len(places)), 2)
             if 100 * len(sets[a] & sets[b]) >= L.PERCENT * len(sets[a] | sets[b])]
    return {places[k][:2] for k, c in enumerate(components(len(places), pairs)) if c != k}


@pytest.mark.parametrize("seed,region", [(5, 2048), (6, 3)])
def test_lines_match_all_pairs(spark, seed, region):
    lines = [t for _, t in copies(seed, groups=12, words=30, most=6)]
    rows = [(k, "\n".join(lines[k * 4:k * 4 + 4] + ["", "a", "same line"])) for k in range(len(lines) // 4)]
    found = {(r.doc_id, k) for r in L.line_dedup(corpus(spark, rows), region).collect() for k in r.dropped}
    want = expected_lines(rows)
    assert len(want - found) <= 0.01 * len(want)
    assert found - want == set()


def test_line_edge_cases(spark):
    rows = L.line_dedup(corpus(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    found = {r.doc_id: (r.n_lines, r.dropped) for r in rows}
    assert found[1] == (0, []) and found[2] == (1, []) and found[3] == (2, []) and found[8] == (1, [0])
    assert sorted(len(r.dropped) for r in rows if r.doc_id == 5) == [0, 1]
    assert L.line_dedup(corpus(spark, [])).count() == 0
    stripped = L.strip_lines(corpus(spark, [(1, "a line here\n\nother"), (2, "a line here\nnew"), (3, None)]))
    assert sorted((r.doc_id, r.text) for r in stripped.collect()) == [(1, "a line here\n\nother"), (2, "new"), (3, None)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_not_exchanged_again(spark):
    """Joins on the class find the bodies in buckets; of the pivots' side both inputs move, so a large pivot can be split."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        bodies = stage_by(spark.range(20).selectExpr("id AS cls", "CAST(2 AS LONG) AS n", "CAST('abcdef' AS BINARY) AS body"), "cls")
        sizes = spark.range(20).selectExpr("id % 7 AS cls", "id AS size")
        assert _plan(sizes.join(bodies, "cls")).count("Exchange hashpartitioning") == 1
        pairs = spark.range(20).selectExpr("id AS c", "id % 3 AS p")
        met = R.measured(pairs, bodies)
        # pairs by c, their pivots, then pairs and pivots' bodies by p
        assert _plan(met).count("Exchange hashpartitioning") == 4
        assert met.count() == 20
    finally:
        spark.conf.set(limit, before)


def test_blocks_do_not_pass_through_pandas(spark):
    members = spark.createDataFrame([(1, 1, 1, True, None, 2), (1, 2, 2, True, None, 2)],
                                    "region long, cls long, comp long, home boolean, d double, n long")
    body = bytearray(R.to_bytes(np.array([3, 9], np.uint64)))
    bodies = spark.createDataFrame([(1, 2, body), (2, 2, body)], "cls long, n long, body binary")
    links = R.join_regions(members, bodies, 75)
    assert "InPandas" not in _plan(links)
    assert [tuple(r) for r in links.collect()] == [(1, 2)]


@pytest.mark.parametrize("often", [1, 2, 512])
def test_packed_keys_of_several_classes(monkeypatch, often):
    monkeypatch.setattr(R, "OFTEN", often)
    rng = np.random.default_rng(often)
    packer, held = R.Packer(3), {}
    batches = []
    for cls in range(200):
        keys = np.unique(rng.integers(0, 400, 5)).astype(np.uint64)
        for s in keys.tolist():
            held.setdefault(s, set()).add(cls)
        packer.add(keys | np.uint64(1 << 54), cls)
        if cls % 50 == 49:
            batches.append(packer.flush())
    found = {}
    for batch in R._shared_rows(iter(batches)):
        for s, cls, least, score, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(s, []).append((cls, k))
            assert (least, score) == (1, 0)
    shared = {s: x for s, x in held.items() if len(x) > 1}
    for s, x in shared.items():
        assert {c for c, _ in found[s]} == x
        assert {k for _, k in found[s]} <= {0, len(x)}
    assert all(k == 0 for s in found.keys() - shared.keys() for _, k in found[s])
    assert often < 512 or found.keys() == shared.keys()


def test_runs_and_bands_by_definition():
    def spread(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2**64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def run(text):
        h = 0
        for x in [ord(c) + 1 for c in text] + [0] * (L.CHARS - len(text)):
            h = (h ^ x) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
        return spread(h)

    lines = ["a", "short", "exactly", "one more character", "\U0001f600 wide", "x" * 40, "ab"]
    own = [[run(x[k:k + L.CHARS]) for k in range(max(1, len(x) - L.CHARS + 1))] for x in lines]
    hashes, counts = L.run_hashes(lines)
    assert counts.tolist() == [len(x) for x in own]
    assert hashes.tolist() == [h for x in own for h in x]
    factors, masks = (x.tolist() for x in L._permutations())
    for keys, x in zip(L.band_keys(lines).tolist(), own, strict=True):
        for band, key in enumerate(keys):
            h = band + 1
            for k in range(band * L.ROWS, (band + 1) * L.ROWS):
                h = spread((h * 0x9E3779B97F4A7C15 + min(((y >> 32) ^ masks[k]) * factors[k] % 2**32 for y in x)) % 2**64)
            assert key == h % 2**48
