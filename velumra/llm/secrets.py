"""Secret scans: candidate strings, and a random forest that removes false positives."""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import released
from .forest import Forest, grow
from .words import unused

#: The bound on labelled findings that the forest is fitted on.
FINDINGS = 8000
THRESHOLD = 0.5
CONTEXT = 64

#: A block of a private key to its end (one without an end: with the lines of
#: base64 that follow), a value that is assigned to a name, quoted or of 8
#: characters that aren't blank, or a run of at least 16 key characters with a
#: digit, without the value that it may name. A value ends where the next name begins.
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{16,}+)*)"
    r"|(?<=[=:] [\"'])[^\s\"']{8,}(?=[\"'])|(?<=[=:][\"'])[^\s\"']{8,}(?=[\"'])"
    r"|(?:(?<=[\w\"'][=:])|(?<=[\w\"'][=:] )|(?<=[\w\"'] [=:] )|(?<=[\w\"'] [=:]))(?P<plain>(?!//)[^\s\"'=:](?:(?![&,;?][\w.-]+[=:])[^\s\"']){6,}(?![&,;?][\w.-]+[=:])[^\s\"'.,;:?)\]}>])"
    r"|(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.-]{16,}+(?:=+(?![^\s\"'=]))?"
)
#: Texts without any of these hold no candidate.
SIGN = re.compile(r"[0-9\"'=:]|-----BEGIN")
DIGIT = re.compile(r"[0-9]")


def candidates(text: str) -> Iterator[re.Match]:
    if SIGN.search(text):
        for m in CANDIDATE.finditer(text):
            quoted = text[m.start() - 1 : m.start()] in ("\"", "'") and m.end() - m.start() >= 8
            if m["plain"] or DIGIT.search(m.group()) or m.group().startswith("-----BEGIN") or (quoted and QUOTED.match(text, m.start())):
                yield m


QUOTED = re.compile(r"(?<=[=:][\"'])[^\s\"']{8,}(?=[\"'])|(?<=[=:] [\"'])[^\s\"']{8,}(?=[\"'])")
NEAR = {
    "secret": 3, "token": 3, "password": 3, "passwd": 3, "pwd": 3, "apikey": 3, "api_key": 3, "api-key": 3, "access_key": 3, "auth": 2,
    "credential": 3, "private": 2, "bearer": 3, "client_secret": 3, "key": 1,
}
FAR = ("commit", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "version", "integrity", "etag", "revision", "build", "example", "order", "invoice", "phone", "card", "isbn", "url", "http", "href", "color", "trace")
PATHS = ("test", "spec", "mock", "fixture", "example", "sample", "doc", "lock", "vendor", ".md", ".min.js", ".svg", ".csv")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "sk-", "AIza", "eyJ", "glpat-", "npm_", "-----BEGIN")
COMMON = frozenset(
    "the of and to in is for on that with as by at from this be are not have was or an it you all can data name file text type value user list line test code page time date "
    "get set add new old id key word url path home main index image item count size left right top bottom width height class style script function return string number table "
    "column order query result error message object model view service server client request response config default internal external public private static final import export "
    "token secret password access account admin login system process thread memory cache buffer stream socket event handler manager factory builder controller component module "
    "package library version release update delete insert select create remove open close start stop begin end first last next previous before after".split()
)
NAMES = ("length", "entropy", "upper", "lower", "digit", "other", "hex", "runs", "transition", "same", "longest_letters", "dictionary", "prefix", "near", "far", "assigned", "quoted", "path_part", "path_test", "uuid", "digits_only", "vowels", "dots", "classes")


def _transitions() -> dict[str, float]:
    """Log probability of a letter after another in ordinary words."""
    counts: dict[str, float] = {}
    for word in COMMON:
        for a, b in zip(word, word[1:]):
            counts[a + b] = counts.get(a + b, 0) + 1
    of = {a: sum(counts.get(a + b, 0) for b in string.ascii_lowercase) for a in string.ascii_lowercase}
    return {a + b: math.log((counts.get(a + b, 0) + 0.5) / (of[a] + 13)) for a in string.ascii_lowercase for b in string.ascii_lowercase}


TRANSITION = _transitions()
KIND = {c: k for k, cs in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits)) for c in cs}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
LETTERS = re.compile(r"[A-Za-z]+")


def describe(found: str, before: str, after: str, path: str) -> list[float]:
    """Length, transitions between characters, dictionary coverage, path and
    neighbouring words of a candidate, as ``NAMES``. Of a key block its first line."""
    if found.startswith("-----BEGIN"):
        found = found[: found.index("-----", 5) + 5]
    n = len(found)
    tally: dict[str, int] = {}
    for c in found:
        tally[c] = tally.get(c, 0) + 1
    kinds = [KIND.get(c, 3) for c in found]
    share = [kinds.count(k) / n for k in range(4)]
    low = found.lower()
    pairs = [TRANSITION[p] for a, b in zip(low, low[1:]) if (p := a + b) in TRANSITION]
    words = [w.lower() for w in PARTS.findall(found)]
    left, around = before.lower(), (before + " " + after).lower()
    near = max([0, *(s for w, s in NEAR.items() if w in left[-32:])])
    tail = before.rstrip("\"'` ")
    return [
        n,
        -sum(v / n * math.log2(v / n) for v in tally.values()),
        share[1], share[0], share[2], share[3],
        float(bool(HEX.match(found))),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(pairs) / len(pairs) if pairs else -2.5,
        sum(a == b for a, b in zip(found, found[1:])) / n,
        max(map(len, LETTERS.findall(found)), default=0) / n,
        sum(len(w) for w in words if w in COMMON) / n,
        float(found.startswith(PREFIXES)),
        near,
        sum(w in around[-120:] for w in FAR),
        float(tail[-1:] in ("=", ":")),
        float(before[-1:] in "\"'`" and before[-1:] != ""),
        float("/" in found and share[3] > 0.08),
        float(any(p in path.lower() for p in PATHS)),
        float(bool(UUID.match(found))),
        float(found.isdigit()),
        sum(c in "aeiou" for c in low) / n,
        found.count(".") / n,
        len(set(kinds)),
    ]


def labelled_findings(count: int = 6000, seed: int = 23) -> list[tuple[str, str, str, str, int]]:
    """Findings with their label (candidate, before, after, path, is_secret).

    No table labels secrets, so these are written from public formats alone:
    the documented shapes of access keys, tokens, passwords and key blocks
    beside the names that configuration files give them; and commits, digests,
    identifiers, numbers, dates, addresses, paths, placeholders and names in
    code beside theirs. The text around is English words of ``COMMON`` and
    made-up words of consonants and vowels."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    words = sorted(COMMON)
    consonants, vowels = "bcdfghjklmnpqrstvwxz", "aeiouy"

    def made_up(least: int = 1, most: int = 5) -> str:
        return "".join(rng.choice(consonants) * (rng.random() < 0.8) + rng.choice(vowels) + rng.choice(["", "", rng.choice("lnrst")]) for _ in range(rng.randint(least, most)))

    def prose() -> str:
        return " ".join((rng.choice(words) if rng.random() < 0.6 else made_up()) + rng.choice(["", "", "", "", ".", ","]) for _ in range(rng.randint(0, 7)))

    def lined(lead: str, tail: str) -> tuple[str, str]:
        return (prose() + rng.choice([" ", " ", "\n", ""]) + lead)[-CONTEXT:], (tail + rng.choice(["", "", ".", ",", ";", ")", "\n"]) + " " + prose())[:CONTEXT]

    def placeholder() -> str:
        """What documentation writes where a secret belongs."""
        mark = rng.choice("_-")
        some = [rng.choice(["your", "my", "insert", "replace", "example", "enter", "the", "dummy"]), *rng.choice(names).replace("-", "_").split("_"), *rng.choice([[], ["here"], ["goes", "here"], ["value"]])]
        text = mark.join(some) + rng.choice(["", mark + str(rng.randint(1, 99)), str(rng.randint(1, 9))])
        return (text.upper() if rng.random() < 0.5 else text).ljust(16, rng.choice("x0"))

    names = ["token", "secret", "password", "api_key", "apikey", "auth_token", "client_secret", "access_key", "secret_access_key", "passwd", "credential", "private_token", "db_password", "signing_key", "bearer"]
    paths = ["src/main.py", "web/index.html", "config/settings.py", "app/main.js", "deploy.yaml", "notes.txt", "docker-compose.yml", ".env", "article", "mail", "wiki", "forum", ""]
    out = []
    for i in range(count):
        path = rng.choice(paths)
        if i % 2 == 0:
            kind = rng.randrange(9)
            found = [
                lambda: pick(hexes, rng.choice([32, 40, 40, 48, 64])),
                lambda: pick(alnum, rng.randint(20, 60)),
                lambda: pick(b64, rng.choice([32, 40, 43])) + rng.choice(["", "="]),
                lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16),
                lambda: rng.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "npm_", "AIza", "sk-"]) + pick(alnum, 36),
                lambda: "eyJ" + pick(alnum, 24) + ".eyJ" + pick(alnum + "_-", 40) + "." + pick(alnum + "_-", 43),
                lambda: pick(alnum + "!@#%^&*", rng.randint(9, 20)),
                lambda: made_up(2, 3).capitalize() + rng.choice("!@#%^&*_-") + pick(string.digits, rng.randint(2, 4)) + rng.choice(["", "!", "#", pick(alnum, 3)]),
                lambda: "-----BEGIN " + rng.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----",
            ][kind]()
            found = found if len(found) >= 8 else found + pick(alnum, 8 - len(found))
            mark = rng.choice([' = "', '="', ': "', "': '", " = '", '": "', "=", ": ", " = "])
            if kind in (3, 4, 5, 8) and rng.random() < 0.4:
                lead, tail = rng.choice(["", "use ", "with ", "("]), ""
            else:
                name = rng.choice(names)
                lead, tail = (name.upper() if rng.random() < 0.25 else name.replace("_", "-") if rng.random() < 0.2 else name) + mark, mark[-1] if mark[-1] in "\"'" else ""
            if kind == 0 and rng.random() < 0.2:
                found = found.upper()
            before, after = lined(lead, tail)
            out.append((found, before, after, path, 1))
        else:
            kind = rng.randrange(14)
            if kind == 0:
                found, lead = pick(hexes, 40), rng.choice(["commit ", "revision: ", "merge ", "sha1: ", 'commit = "', "checkout ", "parent "])
            elif kind == 1:
                found, lead = pick(hexes, rng.choice([32, 64])), rng.choice(["md5: ", "sha256:", 'checksum = "', "hash: ", "digest=", 'etag: "'])
            elif kind == 2:
                h = pick(hexes, 32)
                found, lead = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", rng.choice(["id: ", 'uuid = "', "", "trace ", "request "])
            elif kind == 3:
                found, lead = pick(string.digits, rng.randint(16, 24)), rng.choice(["", "account ", "order ", "invoice: ", "number = ", "isbn ", "tracking "])
            elif kind == 4:
                found, lead = rng.choice(["", "/", "./"]) + "/".join(rng.choices(words, k=rng.randint(3, 6))) + str(rng.randint(1, 99)) + rng.choice(["", ".html", ".py"]), rng.choice(["", 'path = "', "url: ", "import ", 'href="'])
            elif kind == 5:
                found, lead = "".join(w.capitalize() for w in rng.choices(words, k=rng.randint(3, 5))) + str(rng.randint(1, 9)), rng.choice(["", "class ", 'name = "', "new "])
            elif kind == 6:
                found, lead = made_up(6, 9) + rng.choice(["", "1", "22"]), rng.choice(["", 'word: "', 'title = "'])
            elif kind == 7:
                found, lead = ".".join([made_up(2, 3), rng.choice(["", made_up(2, 3) + "."]) + rng.choice(["www", "host", "mx", "cdn"]) + str(rng.randint(0, 20)), made_up(2, 4), rng.choice(["com", "org", "net", "example"])]), rng.choice(["", "host: ", "server=", "at "])
            elif kind == 8:
                found, lead = f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}", rng.choice(["date: ", "at ", 'time = "'])
            elif kind == 9:
                found, lead = rng.choice(["<your-token-here>", "xxxxxxxxxxxxxxxx1", "changeme12345678", "EXAMPLE_KEY_1234567", "your_api_key_123456", "0000000000000000", "aaaaaaaaaaaaaaaa0", "1234567890123456", "${SECRET_KEY_2}", placeholder(), placeholder(), placeholder()]), rng.choice(['token = "', 'api_key: "', "password='", "api_key: ", "secret=", "TOKEN="])
            elif kind == 10:
                found, lead, path = pick(hexes, 40), rng.choice(["integrity ", "resolved ", 'hash "', ""]), rng.choice(["package-lock.json", "vendor/list", "test/fixtures"])
            elif kind == 11:
                found = rng.choice([w for w in words if len(w) >= 8]) if rng.random() < 0.5 else made_up(4, 6)
                found = found if len(found) >= 8 else found + "ations"
                lead = rng.choice(["token", "secret", "password", "key", "credential", "note", "name", "title", "see"]) + rng.choice([": ", "=", " = ", ":"])
            elif kind == 12:
                found = rng.choice([f"{rng.randint(10, 59)}:{rng.randint(10, 59)}.{rng.randint(100, 999)}", pick(string.digits, rng.randint(8, 12)), f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{made_up(2, 4)}.{made_up(2, 4)}@{made_up(2, 4)}.{rng.choice(['com', 'org', 'example'])}", f"https://{made_up(2, 4)}.{rng.choice(['com', 'org'])}/{rng.choice(words)}/{rng.randint(1, 9999)}"])
                lead = rng.choice(["date", "time", "10", "order", "phone", "mail", "contact", "number", "size", "link", "source"]) + rng.choice([": ", "=", " = ", ":"])
            else:
                some = [w.capitalize() if rng.random() < 0.3 else w for w in rng.choices(words, k=rng.randint(3, 5))]
                if rng.random() < 0.4:
                    some.insert(rng.randint(0, len(some)), str(rng.randint(1, 99999)))
                found = some[0] + "".join(rng.choice(["_", "-", ".", "/"] if rng.random() < 0.2 else [some_mark]) + w for w in some[1:] for some_mark in [rng.choice("_-.")]) + str(rng.randint(1, 9))
                lead = rng.choice(["", "", 'name = "', "id: ", 'key: "', "branch ", "see "])
            before, after = lined(lead, lead[-1] if lead[-1:] in ("\"", "'") else "")
            out.append((found, before, after, path, 0))
    return out


def train(findings: list[tuple[str, str, str, str, int]] | None = None, bound: int = FINDINGS) -> Forest:
    """Grow the forest on labelled findings, the first ``bound`` of them."""
    rows = (findings if findings is not None else labelled_findings())[:bound]
    return grow(np.array([describe(*r[:4]) for r in rows]), np.array([r[4] for r in rows]))


def _scan(forest, threshold: float, names: list[str] | None = None):
    def judged(texts: list[str | None], paths: list[str | None]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        places, rows = [], []
        for i, (text, path) in enumerate(zip(texts, paths)):
            for m in candidates(text or ""):
                places.append((i, m.start(), m.end()))
                rows.append(describe(m.group(), text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + CONTEXT], path or ""))
        return places, forest.value.score(np.array(rows)) if rows else np.empty(0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            places, scores = judged(texts, batch.column("source").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i, _, _ in places], pa.int64()), pa.array([a for _, a, _ in places], pa.int32()), pa.array([b for _, _, b in places], pa.int32()),
                    pa.array([texts[i][a:b] for i, a, b in places], pa.string()), pa.array(scores, pa.float64()), pa.array(scores >= threshold, pa.bool_()),
                ],
                names=["doc_id", "begin", "end", "candidate", "score", "is_secret"],
            )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names[0]).to_pylist()
            places, scores = judged(texts, batch.column(names[1]).to_pylist())
            cuts: dict[int, list[tuple[int, int]]] = {}
            for (i, a, b), s in zip(places, scores):
                if s >= threshold:
                    cuts.setdefault(i, []).append((a, b))
            for i, spans in cuts.items():
                parts, at = [], 0
                for a, b in spans:
                    parts += [texts[i][at:a], REDACTED]
                    at = b
                texts[i] = "".join(parts) + texts[i][at:]
            yield batch.append_column(names[2], pa.array(texts, pa.string())).append_column(names[3], pa.array([len(cuts.get(i, ())) for i in range(len(texts))], pa.int32()))

    return clean if names else scan


REDACTED = "<SECRET>"


def findings(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate in every text with its place, the forest's score and
    whether it is a secret (score of at least ``threshold``).

    ``source`` stands for the path. Defined results: null and empty texts have
    no finding; a null source is an empty path, a null doc_id stays null;
    repeated rows repeat their findings; an empty table gives none; other
    columns are ignored. Places count characters of the whole text."""
    model = docs.sparkSession.sparkContext.broadcast(forest or train())
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return named.mapInArrow(released(_scan(model, threshold)), "doc_id bigint, begin int, end int, candidate string, score double, is_secret boolean")


def redacted_documents(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs``, each secret replaced by ``REDACTED`` and n_chars,
    if there is one, counted anew where something was replaced. Defined
    results: null, empty and blank texts stay as they are, as do all columns of
    documents without a secret; a null source is an empty path; repeated rows
    are redacted alike; an empty table stays empty; columns may have any other
    name."""
    model = docs.sparkSession.sparkContext.broadcast(forest or train())
    text, source, clean, hits = names = unused(docs.columns, "__text", "__source", "__clean", "__hits")
    named = docs.select("*", F.col("text").cast("string").alias(text), F.col("source").cast("string").alias(source))
    schema = named.withColumns({clean: F.lit(None).cast("string"), hits: F.lit(0)}).schema
    done = named.mapInArrow(released(_scan(model, threshold, names)), schema)
    hit = F.col(hits) > 0
    changed = {"text": F.when(hit, F.col(clean)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(changed).select(*docs.columns)
