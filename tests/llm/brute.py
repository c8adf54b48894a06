"""Plain versions of the operators, over lists, that share no search or sum with them."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import xxhash

from velumra.llm.words import WORDS

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r + ("en", "src0"))[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], FIELDS)


#: Columns that operators might use for themselves.
CLASHES = "score good label key hub keep group_id sig begin end unit words print tokens start n part local_start candidate is_secret bits virtual_finish __text __source __lang __score __clean __hits __gone_id _s _d".split()


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASHES})


LONG = " ".join(f"w{k % 977}x{k % 1013}" for k in range(120_000))
#: Nulls in every column, empty, blank and very long texts, ties and repeated rows.
ODD = [
    (1, None, None, None), (2, "", "en", "src0"), (3, " \n\t ", "en", "src0"), (4, LONG, "en", "src1"), (5, "one", "en", None), (5, "one", "en", None), (None, "a text without a name", None, "src0"),
    (6, "a tie of equal words here and there", "en", "src0"), (7, "a tie of equal words here and there", "en", "src0"), (8, "\U0001f600 ünï \x00 � 中文", "zh", "src2"),
]


def odd(spark):
    return documents(spark, ODD)


def words(text):
    return WORDS.findall((text or "").lower())


def bigrams(text):
    w = words(text)
    return {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def near_pairs(rows, least):
    """Pairs (i, j, Jaccard index) of word pairs' sets, by an inverted list."""
    sets = {i: s for i, t in rows if (s := bigrams(t))}
    where, shared = defaultdict(list), Counter()
    for i in sorted(sets):
        for g in sets[i]:
            for j in where[g]:
                shared[j, i] += 1
            where[g].append(i)
    out = []
    for (a, b), n in shared.items():
        share = n / (len(sets[a]) + len(sets[b]) - n)
        if share >= least:
            out.append((a, b, share))
    return out


def groups(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


def tokens(text):
    import re

    return len(re.findall(r"[^ \t\n\r\f\x0b]+", text or ""))


def queue(rows, weights, fraction=0.5, seed=17):
    """Rows (source, doc_id, tokens, virtual finish, tokens before), in order."""
    units = defaultdict(int)
    for d, t, _, s in rows:
        units[s, d] += tokens(t)
    null = lambda x: (x is not None, x if x is not None else 0)
    name = lambda x: (x is not None, x or "")
    key = lambda d: hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    served, out = defaultdict(int), []
    for s, d in sorted(units, key=lambda u: (name(u[0]), key(u[1]), null(u[1]))):
        served[s] += units[s, d]
        out.append((served[s] / weights.get(s, 1.0), s, key(d), d, units[s, d]))
    out.sort(key=lambda r: (r[0], name(r[1]), r[2], null(r[3])))
    budget, at, kept = math.floor(sum(units.values()) * fraction), 0, []
    for finish, s, _, d, n in out:
        if at + n <= budget:
            kept.append((s, d, n, finish, at))
        at += n
    return kept


def windows(rows, size, eos, encode):
    """[(tokens, [(doc_id, place in its tokens, place in the window, count)])]."""
    null = lambda x: (x is not None, x if x is not None else 0)
    raw = lambda t: (t or "").encode("utf-8", "surrogatepass")
    hashed = lambda t: 42 if t is None else int.from_bytes(xxhash.xxh64_digest(raw(t), seed=42), "big", signed=True)
    order = sorted(rows, key=lambda r: (null(r[0]), hashed(r[1]), r[1] is not None, raw(r[1])))
    stream = [(d, k, t) for d, text, *_ in order for k, t in enumerate([*encode(text or ""), *([] if eos is None else [eos])])]
    out = []
    for at in range(0, len(stream), size):
        part, records = stream[at : at + size], []
        for k, (d, place, _) in enumerate(part):
            if records and place and records[-1][0] == d and records[-1][1] + records[-1][3] == place:
                records[-1][3] += 1
            else:
                records.append([d, place, k, 1])
        out.append(([t for _, _, t in part], [tuple(r) for r in records]))
    return out
