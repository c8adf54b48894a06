import itertools
import random
from pathlib import Path

import brute
import numpy as np
import pytest

from velumra.llm import queries, substrings
from velumra.llm.words import WordHashes
from velumra.plans import lineage

SF = "/root/testdata/sf0.001"


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + ". "


def planted(seed=0, many=40):
    """Documents of their own sentences, some with a passage of 60 words or more that others hold too."""
    rng = random.Random(seed)
    passages = ["".join(sentence(rng, rng.randint(9, 15)) for _ in range(6)) for _ in range(4)]
    rows, holders = [], {}
    for d in range(many):
        parts = [sentence(rng, rng.randint(5, 20)) for _ in range(rng.randint(3, 12))]
        if d % 4 != 3:
            p = (d // 4) % 4
            parts.insert(rng.randrange(len(parts)), passages[p])
            holders.setdefault(p, []).append(d)
        rows.append((d, "".join(parts)))
    return rows, passages, holders


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.begin, r.end, r.words, r.first_doc_id, r.remove))
    return out


def test_planted_passages(spark):
    rows, passages, holders = planted()
    texts = dict(rows)
    got = found(substrings.repeated_passages(brute.documents(spark, rows)))
    assert got.keys() == {d for ds in holders.values() for d in ds}
    for p, ds in holders.items():
        for d in ds:
            (begin, end, words, first, remove), *more = got[d]
            at = texts[d].index(passages[p])
            covered = min(end, at + len(passages[p])) - max(begin, at)
            assert not more and covered > 0.85 * len(passages[p]) and end - begin < 1.3 * len(passages[p])
            assert first == min(ds) and remove == (d != min(ds))


def plain(rows, similar=substrings.SIMILAR, passage=substrings.PASSAGE):
    """All pairs of different paragraphs compared; then clusters and runs."""
    known, units = WordHashes(), {}
    for d, t in {(d, t) for d, t in rows if d is not None and t}:
        ends, counts, h = substrings.paragraphs(t, known)
        first = begin = 0
        for k, (end, n) in enumerate(zip(ends, counts)):
            units[d, k, begin, end] = tuple(h[first : first + n].tolist())
            first, begin = first + n, end
    sets = {u: {u[k : k + 2] for k in range(len(u) - 1)} or {u} for u in set(units.values())}
    long = [u for u in sets if len(u) >= substrings.LEAST]
    where, pairs = {}, []
    for i, u in enumerate(long):
        for j in {j for g in sets[u] for j in where.get(g, ())}:
            if brute.jaccard(sets[u], sets[long[j]]) >= similar:
                pairs.append((i, j))
        for g in sets[u]:
            where.setdefault(g, []).append(i)
    top = brute.groups(pairs)
    cluster = {u: ("c", top[i]) for i, u in enumerate(long) if i in top}
    members = {}
    for (d, k, *_), u in units.items():
        members.setdefault(cluster.get(u, u), []).append((d, k))
    repeated = {key for key, at in members.items() if len({d for d, _ in at}) > 1}
    out, run = [], []
    for (d, k, a, b), u in sorted(units.items()):
        key = cluster.get(u, u)
        if run and (key not in repeated or run[-1][:2] != (d, k - 1)):
            out.append(run)
            run = []
        if key in repeated:
            run.append((d, k, a, b, len(u), min(members[key])))
    out = [r for r in [*out, run] if r and sum(x[4] for x in r) >= passage]
    pieces = [list(g) for r in out for _, g in itertools.groupby(r, lambda x: x[:2] != x[5])]
    return sorted((r[0][0], r[0][2], r[-1][3], sum(x[4] for x in r), min(x[5][0] for x in r), r[0][:2] != r[0][5]) for r in pieces)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, got = set(plain(rows)), {tuple(r) for r in queries.op8_substrings(spark, SF).collect()}
    places = lambda s: {(d, p) for d, a, b, *_ in s for p in range(a, b, 20)}
    assert want and len(got & want) >= 0.97 * len(want) and len(places(got) & places(want)) >= 0.99 * len(places(got) | places(want))


@pytest.mark.parametrize("part", [4096, 8])
def test_near_pairs_in_crowded_buckets(spark, monkeypatch, part):
    """Pairs of near paragraphs, all with the same beginning: no pair is like
    the others, but they share buckets. Paragraphs of 31 words stay whole."""
    monkeypatch.setattr(substrings, "PART", part)
    monkeypatch.setattr(substrings, "LONGEST", 40)
    rng, rows = random.Random(11), []
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    start = [word() for _ in range(25)]
    for k in range(150):
        own = [word() for _ in range(6)]
        for d, change in ((2 * k, ()), (2 * k + 1, (1, 3))):
            rows.append((d, " ".join(start + [word() if i in change else w for i, w in enumerate(own)]) + "."))
    want = plain(rows)
    got = {tuple(r) for r in substrings.repeated_passages(brute.documents(spark, rows)).collect()}
    assert len(want) == 300 and len(got & set(want)) >= 0.97 * len(want)


def test_no_passage_is_removed_everywhere(spark):
    """P; P and Q side by side; Q."""
    rng = random.Random(2)
    p, q = ("".join(sentence(rng, 12) for _ in range(5)) for _ in range(2))
    got = found(substrings.repeated_passages(brute.documents(spark, [(1, p), (2, p + q), (3, q)])))
    assert got[1] == [(0, len(p), 60, 1, False)] and got[3] == [(0, len(q), 60, 2, True)]
    assert sorted(got[2]) == [(0, len(p), 60, 1, True), (len(p), len(p + q), 60, 2, False)]


def test_one_copy_of_every_paragraph_stays(spark):
    """Documents of paragraphs from a small pool, in any order."""
    rng = random.Random(9)
    pool = [sentence(rng, rng.randint(9, 20)) for _ in range(25)]
    rows = [(d, "".join(rng.sample(pool, 6))) for d in range(30)]
    got, texts = found(substrings.repeated_passages(brute.documents(spark, rows))), dict(rows)
    left = " ".join("".join(c for k, c in enumerate(texts[d]) if not any(a <= k < b and gone for a, b, _, _, gone in got.get(d, ()))) for d in texts)
    used = [s for s in pool if any(s in t for t in texts.values())]
    assert all(left.count(s.strip()) == 1 for s in used)


@pytest.mark.parametrize("least, most, words, share", [(5, 20, 51, 0.93), (10, 35, 51, 0.85), (10, 35, 60, 0.95), (500, 500, 60, 0.85), (500, 500, 80, 0.95)])
def test_passages_that_begin_inside_a_sentence(spark, least, most, words, share):
    """Pasted anywhere into sentences of that many words; 500 are text without stops."""
    rng, rows = random.Random(least + words), []
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))

    def prose(n):
        out = []
        while len(out) < n:
            out += [word() for _ in range(rng.randint(least, most))]
            out[-1] += "."
        return out[:n]

    for k in range(150):
        passage = prose(words + 40)[20 : 20 + words]
        rows += [(2 * k + c, " ".join(prose(rng.randint(30, 90)) + passage + prose(rng.randint(30, 90)))) for c in range(2)]
    got = found(substrings.repeated_passages(brute.documents(spark, rows)))
    hit = sum(2 * k in got and 2 * k + 1 in got for k in range(150))
    print(least, most, words, hit / 150)
    assert hit >= share * 150


def test_bands_find_near_paragraphs():
    """Of pairs at the threshold, over 0.99 share a band."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**32, (4000, 34), dtype=np.int64)
    a, b = np.sort(x[:, :28]).astype("<u4"), np.sort(np.concatenate([x[:, :23], x[:, 28:33]], 1)).astype("<u4")
    assert 23 / 33 < 0.7
    keys = [substrings.band_keys([r.tobytes() for r in side]) for side in (a, b)]
    assert (keys[0] == keys[1]).any(1).mean() > 0.985
    sets = [[r.tobytes() for r in side] for side in (a, b)]
    assert not substrings.alike(*sets, 0.7).any() and substrings.alike(*sets, 0.69).all()


def test_links_connect_as_all_pairs_do():
    rng = random.Random(5)
    for _ in range(50):
        base = rng.sample(range(60), 24)
        sets = [set(base) ^ set(rng.sample(range(60), rng.randint(0, 9))) for _ in range(30)]
        hub, rest = sets[0], sets[1:]
        alike = [brute.jaccard(hub, x) >= 0.7 for x in rest]
        got = substrings.links(list(range(1, 30)), alike, [np.array(sorted(x), np.uint64) for x in rest], 0.7)
        assert all(brute.jaccard(sets[a], sets[b]) >= 0.7 for a, b in got)
        every = [(a, b) for a in range(30) for b in range(a) if brute.jaccard(sets[a], sets[b]) >= 0.7]
        assert brute.groups(got + [(0, k + 1) for k, yes in enumerate(alike) if yes]) == brute.groups(every)


def test_lines_without_stops(spark):
    rng = random.Random(3)
    passage = " ".join("".join(rng.choices("klmnopq", k=5)) for _ in range(160))
    rows = [(d, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(100)) + " " + passage + " " + " ".join("".join(rng.choices("rstuvw", k=6)) for _ in range(100))) for d in range(3)]
    got = found(substrings.repeated_passages(brute.documents(spark, rows)))
    assert got.keys() == {0, 1, 2} and all(sum(b - a for a, b, *_ in v) > 0.6 * len(passage) for v in got.values())


def test_near_paragraphs_are_found(spark):
    rows, passages, _ = planted(seed=7, many=3)
    words = passages[0].split(" ")
    changed = " ".join("changed" if k % 29 == 5 else w for k, w in enumerate(words))
    got = found(substrings.repeated_passages(brute.documents(spark, [(1, passages[0]), (2, changed)])))
    assert got.keys() == {1, 2}


def test_odd_rows(spark):
    text = planted()[1][0]
    rows = brute.ODD + [(20, text, None, None), (21, text, "en", "x"), (21, text, "en", "x"), (None, text, "en", "x"), (22, brute.LONG + ". " + text, "en", None)]
    got = found(substrings.repeated_passages(brute.clashing(brute.documents(spark, rows))))
    assert {20, 21, 22} <= got.keys() <= {4, 20, 21, 22} and len(got[21]) == 1 and not got[20][0][4] and got[21][0][4]
    assert substrings.repeated_passages(brute.odd(spark).limit(0)).count() == 0
    assert substrings.repeated_passages(brute.documents(spark, [(1, text), (1, text)])).count() == 0


def test_bands_take_room_in_turns(spark, monkeypatch):
    """The shuffle files of some bands are deleted before the next are written; passages are the same."""
    places = [Path(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    room = lambda: sum(p.stat().st_size for place in places for p in place.rglob("shuffle_*.data"))
    docs, real, said, got = brute.documents(spark, planted(seed=4, many=600)[0]).cache(), substrings.table, [], []

    def table(df, name):
        before, out = room(), real(df, name)
        if name == "ties":
            said[-1].append((before, room()))
        return out

    monkeypatch.setattr(substrings, "table", table)
    for rounds in (1, substrings.ROUNDS):
        monkeypatch.setattr(substrings, "ROUNDS", rounds)
        lineage.tidy(spark)
        said.append([])
        got.append(sorted(map(tuple, substrings.repeated_passages(docs).collect())))
    (once,), turns = said
    start = turns[0][0]
    print(said)
    assert len(turns) == 2 and max(after - start for _, after in turns) < 0.7 * (once[1] - once[0])
    assert got[0] and got[0] == got[1]
