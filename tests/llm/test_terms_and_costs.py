"""Cost-balanced packing, source divergence and lexical search against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import EDGE, copies, corpus
from tokenizers import Tokenizer

from unitwise.llm import cost_packing, divergence, lexical


def naive_assign(lengths, capacity, linear, quadratic):
    """The rule by scanning every sequence for every piece."""
    rooms = cost_packing.rooms_for(sum(lengths), capacity)
    left, costs, out = list(rooms), [0] * len(rooms), []
    due = sorted(((-n, k, 0) for k, n in enumerate(lengths)))
    while due:
        n, item, start = due.pop(0)
        n = -n
        fitting = [s for s in range(len(rooms)) if left[s] >= n]
        best = min(fitting or [s for s in range(len(rooms)) if left[s]], key=lambda s: (costs[s], left[s], s))
        put = min(n, left[best])
        out.append((start, put, costs[best]))
        costs[best] += linear * put + quadratic * put * put
        left[best] -= put
        if put < n:
            at = next((k for k, d in enumerate(due) if -d[0] < n - put), len(due))
            due.insert(at, (put - n, item, start + put))
    return out, costs


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([(6, 1), (0, 1), (1, 0)]))
def test_assignment_follows_the_rule(lengths, weights):
    parts, costs = cost_packing.assign(np.array(lengths, np.int64), 64, *weights)
    naive, naive_costs = naive_assign(lengths, 64, *weights)
    assert [(a, n) for _, a, n, _, _ in parts] == [(a, n) for a, n, _ in naive]
    assert costs == naive_costs
    held = defaultdict(list)
    for item, start, n, sequence, offset in parts:
        held[sequence].append((offset, n))
    assert [sum(n for _, n in held[s]) for s in range(len(costs))] == cost_packing.rooms_for(sum(lengths), 64)


def test_costs_are_balanced():
    lengths = np.minimum(2048, np.random.default_rng(1).lognormal(6.3, 0.9, 6000).astype(np.int64) + 1)
    parts, costs = cost_packing.assign(lengths)
    full = np.array(costs[:int(lengths.sum()) // 2048])
    least = cost_packing.LINEAR * 2048
    whole = least + 2048 ** 2
    # First fit in table order, for comparison, spreads the quadratic part more.
    rows = np.split(lengths, np.flatnonzero(np.diff(np.cumsum(lengths) // 2048)) + 1)
    plain = np.array([(r ** 2).sum() for r in rows]) + least
    assert full.std() < plain.std() and full.max() <= whole
    assert len(parts) - len(lengths) <= len(costs)


def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [*EDGE, *((100 + k, t, "en", "s", None, None, 1, 1, 1) for k, t in copies(3))]
    for parts in (1, 3):
        found = cost_packing.cost_balanced_packing(corpus(spark, rows).repartition(parts)).collect()
        ids = [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]
        want = Counter((r[0], len(x)) for r, x in zip(rows, ids, strict=True))
        of = {r[0]: x for r, x in zip(rows, ids, strict=True)}
        placed, starts = defaultdict(list), defaultdict(list)
        for r in found:
            own = of[r.doc_id][r.start:r.start + r.length]
            assert r.length > 0 and len(own) == r.length and r.ids_crc32 == zlib.crc32(own.tobytes())
            assert r.doc_tokens == len(of[r.doc_id])
            placed[r.sequence_id].append((r.offset, r.length, r.sequence_cost))
            starts[r.doc_id].append((r.start, r.length))
        assert sum(n for x in placed.values() for _, n, _ in x) == sum(map(len, ids))
        for own in placed.values():
            own.sort()
            assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in pairwise(own))
            total = own[-1][0] + own[-1][1]
            assert total <= 2048 and total & total - 1 == 0  # a power of two, 2048 included: no padding
            assert {c for _, _, c in own} == {sum(6144 * n + n * n for _, n, _ in own)}
        for doc, own in starts.items():
            copies_ = sum(n for (d, _), n in want.items() if d == doc)
            covered = Counter(k for a, n in own for k in range(a, a + n))
            assert set(covered.values()) == {copies_} and len(covered) == len(of[doc])
    assert cost_packing.cost_balanced_packing(corpus(spark, [])).count() == 0


def brute_divergence(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))) for t, l, s in rows]
    within, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        within[lang].update(set(terms))
        held[lang, source].update(terms)
        held[lang,].update(terms)
    kept = {lang: sorted(t for t, n in c.items() if n >= 3) for lang, c in within.items()}
    p = {}
    for key, counts in held.items():
        own = kept[key[0]]
        total = sum(counts[t] for t in own) + len(own)
        p[key] = {t: 1 + 1_000_000_000 * (counts[t] + 1) // total for t in own}
    out = set()
    for key in held:
        if len(key) == 1:
            continue
        lang, source = key
        f = lambda t, q: (p[key][t] - q[t]) ** 2 // q[t]
        pairs = [(-sum(f(t, p[o]) for t in kept[lang]), o[1].encode()) for o in held if len(o) == 2 and o[0] == lang and o != key]
        terms = [(-f(t, p[lang,]), t.encode()) for t in kept[lang] if held[key][t] and p[key][t] > p[lang,][t]]
        for part, some in (("pair", pairs), ("term", sorted(terms)[:200])):
            out |= {(lang, source, part, i.decode(), -v, k) for k, (v, i) in enumerate(sorted(some), 1)}
    return out


def divergence_rows(seed, n=160):
    rng = random.Random(seed)
    words = ["Cat", "cat,", "(CAT)", "dog-dog", "über", "ÜBER", "a1b", "x", "1", "--", "日本", "ſ", "the", "The.", "rare%d"]
    for _ in range(n):
        text = rng.choice([" ", "\n", "\t"]).join(
            (w % rng.randrange(40) if "%" in w else w) for w in rng.choices(words, k=rng.randrange(12)))
        yield rng.choice([text, text, None]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "Z", None])


@pytest.mark.parametrize("parts", [1, 4])
def test_divergence_equals_brute_force(spark, parts):
    rows = [(t, lang, s) for _, t, lang, s, *_ in EDGE] + list(divergence_rows(parts)) + [
        ("solo", "only", "one"), ("x y", "two", "p"), ("z", "two", "q")]
    rows += rows[:5]
    table = corpus(spark, [(k, t, lang, s, None, None, 1, 1, 1) for k, (t, lang, s) in enumerate(rows)])
    found = divergence.source_divergence(table.repartition(parts)).collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == brute_divergence(rows)
    assert divergence.source_divergence(corpus(spark, [])).count() == 0


def test_tally_counts_documents_and_keeps_state_small(monkeypatch):
    """Merging at every step gives what one merge at the end gives."""
    rng = np.random.default_rng(4)
    truth, cells = defaultdict(set), Counter()
    tally = divergence.Tally()
    for batch in range(12):
        n = 50
        key, doc, group = rng.integers(0, 40, n), rng.integers(0, 6, n), rng.integers(0, 3, n)
        for k, d, g in zip(key.tolist(), doc.tolist(), group.tolist(), strict=True):
            truth[k].add(d)
            cells[k, g] += 1
        for k in range(40):
            tally.keys[b"k%d" % k]
        tally.langs["en"]
        tally.add(np.zeros(n, np.int64), key, doc, doc, np.zeros(n, np.int64), np.arange(n), group, np.ones(n, np.int64))
        if batch % 2:
            tally.merge()
    rows = [r for b in tally.flush() for r in b.to_pylist()]
    assert {int(r["key"][1:]): r["more"] for r in rows} == {k: len(d) >= 3 for k, d in truth.items()}
    for r in rows:
        if not r["more"]:
            assert {r["first"], r["last"]} == truth[int(r["key"][1:])]
    assert {(int(r["key"][1:]), g): n for r in rows for g, n in zip(r["groups"], r["counts"], strict=True)} == cells


def test_chunks_are_broken_up_once(spark, monkeypatch):
    """Sorted rows of a chunk share one factorization, across batches too."""
    import pyarrow as pa
    rows = [("en", "a,b", 1, 1, False, [7], [2]), ("de", "a,b", 2, 2, False, [8], [1]), ("en", "a,b", 3, 3, False, [7], [1])]
    names = [x.split()[0] for x in divergence.TALLY.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    calls = []
    real = divergence.Counter
    monkeypatch.setattr(divergence, "Counter", lambda *a: calls.append(a) or real(*a))
    out = [r for b in divergence.chunks_to_terms(iter([batch, batch])) for r in b.to_pylist()]
    assert len(calls) == 2  # the empty start and the one chunk
    assert {(r["lang"], r["key"]): r["counts"] for r in out} == {
        ("en", "a"): [6], ("en", "b"): [6], ("de", "a"): [2], ("de", "b"): [2]}


def brute_search(docs, items):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    own = [(d, split(t)) for d, t in docs]
    count, total = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = Counter(t for _, x in own for t in set(x))
    out = {}
    for item, text in items.items():
        asked, found = Counter(split(text)), []
        for doc, terms in own:
            tf, score = Counter(terms), 0
            for t, k in asked.items():
                if tf[t]:
                    m = 25 + 75 * len(terms) * count // total
                    score += k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (
                        1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0))
        out[item] = [(k, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(found)[:10], 1)]
    return out


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 32), (400, 3)])
def test_search_equals_brute_force(spark, shard, block):
    docs = [(r[0], r[1]) for r in EDGE] + [(100 + k, t) for k, t in copies(5, groups=12)]
    items = {k: t for k, t in copies(5, groups=12)[::4]}
    items |= {900: None, 901: "", 902: "nowhere-to-be-found", 903: "one ONE two", None: docs[12][1], 904: docs[9][1]}
    rows = [(k, t, "x", 1) for k, t in items.items()] + [(903, "zzz", "y", 2)]
    asked = spark.createDataFrame(rows, "item_id long, text string, lang string, doc_id long")
    found = defaultdict(list)
    for r in lexical.search(corpus(spark, docs).repartition(3), asked, shard=shard, block=block).collect():
        found[r.item_id].append((r.rank, r.doc_id, r.score))
    for item, want in brute_search(docs, items).items():
        assert sorted(found[item]) == want
    assert lexical.search(corpus(spark, []), asked).count() == 0
    assert lexical.search(corpus(spark, docs), asked.limit(0)).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    docs = copies(6, groups=8)
    asked = spark.createDataFrame(docs[::3], "item_id long, text string")
    one = sorted(lexical.search(corpus(spark, docs), asked).collect())
    monkeypatch.setattr(lexical, "ITEM_BYTES", 1500)
    assert sorted(lexical.search(corpus(spark, docs), asked).collect()) == one


def test_blocks_are_skipped_only_below_the_bound():
    """On clustered documents most are never scored, and the best are the same."""
    rng = np.random.default_rng(2)
    topics = [rng.choice(300, 25, replace=False) for _ in range(60)]
    texts = [" ".join(f"t{k}" for k in [*rng.choice(topics[d % 60], 15), 0, 1, 2]) for d in range(3000)]
    asked = [" ".join(f"t{k}" for k in [*topics[q], 0, 1, 2]) for q in range(20)]
    items = lexical.Items(asked)
    sizes, term, tf, n = [], [], [], []
    for text in texts:
        own = Counter(items.numbers[t] for t in lexical.terms_of(text.encode().decode()) if t in items.numbers)
        sizes.append(len(own))
        n.append(18)
        term += sorted(own)
        tf += [own[t] for t in sorted(own)]
    sizes, term, tf = (np.array(x, np.int64) for x in (sizes, term, tf))
    df = np.bincount(term, minlength=len(items.numbers))
    weights = np.array([math.floor(1000 * math.log(6002 / (2 * d + 1))) for d in df])
    index = lexical.Shard(np.arange(3000), sizes, term, lexical.impacts(tf, np.repeat(18, len(tf)), 3000, 54000), items, weights)
    dense = np.zeros((3000, len(weights)), np.int64)
    dense[np.repeat(np.arange(3000), sizes), term] = index.impact
    for q in range(20):
        asked_ = np.zeros(len(weights), np.int64)
        asked_[items.terms[q]] = items.times[q] * weights[items.terms[q]]
        scores = dense @ asked_
        best = np.lexsort((np.arange(3000), -scores))[:10]
        ids, found = index.search(q, 10)
        assert ids.tolist() == best.tolist() and found.tolist() == scores[best].tolist()
    assert index.scored < 20 * 3000 / 3
    docs, starts, coordinate, greatest, summary = index.open(int(items.terms[0][3]))
    for b, (lo, hi) in enumerate(pairwise(starts.tolist())):
        own = dict(zip(coordinate[np.append(summary, len(coordinate))[b]:np.append(summary, len(coordinate))[b + 1]].tolist(),
                       greatest[np.append(summary, len(coordinate))[b]:np.append(summary, len(coordinate))[b + 1]].tolist(), strict=True))
        top = dense[docs[lo:hi]].max(axis=0)
        assert all(top[t] == x for t, x in own.items())
