"""Secret scan: a linear-chain conditional random field tags tokens, Viterbi decodes.

Tags: O (outside), B (begins a secret), I (inside). Features of a token are its
shape, the words beside it and properties of the whole file. Every token of
every text is scored, and the tags are those of Viterbi over the whole text (see
Decoder, which looks at a word once and leaves out only what can't matter).

The field is trained on a bounded sample of rows (SAMPLE_ROWS), labelled by the
base patterns, and on MADE_RUNS runs written here: random keys of many kinds in
the places where people leave them, among the words of the sample, and look-alikes
that are no secrets. So it doesn't learn the base patterns only. Those patterns'
own spans are always reported, and the field adds the secrets found elsewhere.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pii import digest

KINDS = ("assign", "access", "hex")
#: Rows, at most, whose base spans label the training runs; runs, and tokens of a run.
SAMPLE_ROWS, SAMPLE_RUNS, RUN_TOKENS = 4000, 3000, 48
#: Runs with made keys and look-alikes that are trained on as well.
MADE_RUNS = 1500
EPOCHS, RATE, L2 = 8, 0.3, 1e-3
#: Runs of a step of training, and steps at least.
BATCH, STEPS = 32, 1500
SPANS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
MARKS = "0123456789=:_/+\"'"
_MARK = re.compile(f"[{MARKS}]")
_TOKEN = re.compile(common.WORD)
_KEY = re.compile(r"pass(word|wd|phrase)?|secret|token|api_?key|access_?key|private|credential|auth|bearer|pwd", re.I)
_KEYS = ("pass", "secret", "token", "key")
_TRIM = "\"'`,;!?()[]{}<>*&%$#"
#: What may stand around a plain word: the marks of _TRIM that mean nothing to its neighbours.
_AROUND = "`,;.!?()[]{}<>*&%$#"
_NO_VOWELS, _HEX_DIGITS = str.maketrans("", "", "aeiouyAEIOUY"), "0123456789abcdefABCDEF"
#: What a neighbouring word can be.
_CLASSES = ("none", "sets", "keysets", "key", "mark", "plain")
#: Bytes of words that a decoder remembers, about, and tokens that it scores at a time.
CACHE_BYTES, BATCH_TOKENS = 48_000_000, 200_000


def base_spans(text: str) -> list[tuple]:
    """(kind, start, end), leftmost and non-overlapping per kind, by start and then kind."""
    out = []
    low = text.lower() if ":" in text or "=" in text else ""
    if low and any(k in low for k in _KEYS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _secret_ranges(text: str) -> list[tuple[int, int]]:
    """The values alone, for labels: of an assignment, what is assigned."""
    out = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return out + [(a, b) for k, a, b in base_spans(text) if k != "assign"]


def shape(token: str) -> list[str]:
    """Length, kinds of characters, and whether the token holds a key word or an assignment."""
    core = token.strip(_TRIM + ".")
    n = len(core)
    digits = sum(c.isdigit() for c in core)
    upper = sum(c.isupper() for c in core)
    if n == 0:
        kind = "mark"
    elif digits == n:
        kind = "digits"
    elif all(c in "0123456789abcdefABCDEF" for c in core):
        kind = "hex"
    elif core.isalnum() and core.isascii():
        kind = "mixed" if digits and upper else "alnum" if digits else "alpha"
    elif all(c.isalnum() or c in "+/_=-." for c in core) and core.isascii():
        kind = "base64"
    else:
        kind = "other"
    size = next(i for i, most in enumerate((0, 3, 7, 11, 15, 19, 27, 35, 1 << 60)) if n <= most)
    value = _value(core)
    turns = min(6, _turns(value))
    mixture = f"m{_size(len(value))}t{turns}"
    vowels = sum(c in "aeiouyAEIOUY" for c in value) * 8 // max(1, len(value))
    return [f"s{kind}", f"l{size}", f"s{kind}l{size}", f"d{digits * 4 // max(n, 1)}", "q" if token[:1] in "\"'" else "-q", "k" if _KEY.search(core) else "-k", "=" if "=" in core[:-1] or ":" in core[:-1] else "-=",
            mixture, f"v{min(4, vowels)}", f"{mixture}v{min(4, vowels)}", "web" if "://" in core or "@" in core or core[:1] == "/" or core.count("/") > 2 else "-web", "head" if _HEAD.match(value) else "-head"]


_HEAD = re.compile(r"(?:[A-Za-z]{2,6}[_-](?:[a-z]{3,5}[_-])?|eyJ|AIza|SG\.)[A-Za-z0-9]{8}")


def _value(core: str) -> str:
    """What an assignment within a token assigns, else the token."""
    at = max(core.rfind("=", 0, -2), core.rfind(":", 0, -2))
    value = core[at + 1 :].strip(_TRIM)
    return value if at > 0 and len(value) >= 12 and "//" not in value else core


def _size(n: int) -> int:
    return next(i for i, most in enumerate((7, 11, 15, 19, 27, 35, 1 << 60)) if n <= most)


def _turns(value: str) -> int:
    """How often the kind of character changes, but for a capital that begins a word."""
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "." for c in value)
    return len(_TURN.findall(kinds))


_TURN = re.compile(r"d(?=[ul])|[ul](?=d)|u(?=ul)|l(?=u[^l]|uu)|l(?=ul{1,2}[ud])")


def _beside(token: str) -> str:
    if not token:
        return "none"
    if token in ("=", ":", ":=", "=>"):
        return "sets"
    if _KEY.search(token):
        return "keysets" if token[-1] in "=:" else "key"
    return "mark" if _MARK.search(token) else "plain"


def features(words: list[str], file: list[str]) -> list[list[str]]:
    """Features of each word of a text."""
    near = ["none", "none", *map(_beside, words), "none"]
    return [[*shape(w), f"p{near[i + 1]}", f"pp{near[i]}", f"n{near[i + 3]}", *file] for i, w in enumerate(words)]


def file_features(text: str) -> list[str]:
    """Of the whole file: how much it assigns and whether it looks like code."""
    sets = text.count("=")
    return [f"f={min(3, sets)}", "fcode" if "{" in text and ";" in text else "ftext"]


class Field:
    """Weights of features for (O, B, I), and of tag pairs."""

    def __init__(self, weights: dict, pairs: list):
        self.weights, self.pairs = weights, pairs

    def scores(self, feats: list[list[str]]) -> list[list[float]]:
        w = self.weights
        out = []
        for fs in feats:
            row = [0.0, 0.0, 0.0]
            for f in fs:
                if x := w.get(f):
                    row = [row[0] + x[0], row[1] + x[1], row[2] + x[2]]
            out.append(row)
        return out

    def viterbi(self, feats: list[list[str]]) -> list[int]:
        """Best tags of a run; the tokens on either side are O."""
        return self.decode(self.scores(feats))

    def decode(self, rows: list[list[float]]) -> list[int]:
        """viterbi() of scores."""
        pairs = self.pairs
        best, back = [pairs[0][t] + rows[0][t] for t in range(3)], []
        for row in rows[1:]:
            step = [max((best[s] + pairs[s][t], s) for s in range(3)) for t in range(3)]
            best = [v + row[t] for t, (v, _) in enumerate(step)]
            back.append([s for _, s in step])
        tag = max(range(3), key=lambda t: best[t] + pairs[t][0])
        tags = [tag]
        for step in reversed(back):
            tags.append(tag := step[tag])
        return tags[::-1]


NEVER = -1e6


def train(data: list[list[tuple[int, list[str]]]], epochs: int = EPOCHS, steps: int = STEPS) -> Field:
    """Fit a field to runs of (tag, features) by AdaGrad on the log likelihood.

    Runs are taken BATCH at a time, epochs times over, and more often where that
    makes fewer than `steps` steps.
    """
    data = [r for r in data if r]
    number: dict[str, int] = {}
    for run in data:
        for _, fs in run:
            for f in fs:
                number.setdefault(f, len(number) + 1)  # 0 stands for no feature
    batches = []
    for at in range(0, len(data), BATCH):
        some = data[at : at + BATCH]
        n, width = max(map(len, some)), max(len(fs) for run in some for _, fs in run)
        feats, tags, real = np.zeros((len(some), n, width), np.int32), np.zeros((len(some), n), np.int64), np.zeros((len(some), n), bool)
        for i, run in enumerate(some):
            for j, (tag, fs) in enumerate(run):
                tags[i, j], real[i, j] = tag, True
                feats[i, j, : len(fs)] = [number[f] for f in fs]
        batches.append((feats, tags, real))
    w, pairs = np.zeros((len(number) + 1, 3)), np.array([[0.0, 0.0, NEVER], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    w_size, pair_size = np.full_like(w, 1e-8), np.full_like(pairs, 1e-8)
    for _ in range(max(epochs, -(-steps // max(1, len(batches))))):
        for feats, tags, real in batches:
            node, edge = _gradient(w[feats].sum(axis=2), pairs, tags, real)
            g = np.stack([np.bincount(feats.ravel(), np.repeat(node[:, :, t].ravel(), feats.shape[2]), len(w)) for t in range(3)], axis=1)
            g -= L2 * w
            g[0] = 0.0
            edge[pairs == NEVER] = 0.0
            w_size += g * g
            pair_size += edge * edge
            w += RATE * g / np.sqrt(w_size)
            pairs += RATE * edge / np.sqrt(pair_size)
    return Field({f: w[i].tolist() for f, i in number.items()}, pairs.tolist())


def _gradient(rows: np.ndarray, pairs: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of runs (scores by run, token, tag): by token and tag, and by pair of tags, the ends being O."""
    many, n, _ = rows.shape
    lse = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
    ends = real.sum(axis=1) - 1
    ahead, after = np.zeros_like(rows), np.zeros_like(rows)
    ahead[:, 0] = pairs[0] + rows[:, 0]
    for i in range(1, n):
        ahead[:, i] = lse(ahead[:, i - 1, :, None] + pairs, 1) + rows[:, i]
    after[:, n - 1] = pairs[:, 0]
    for i in range(n - 2, -1, -1):
        after[:, i] = np.where((i >= ends)[:, None], pairs[:, 0], lse(pairs + (rows[:, i + 1] + after[:, i + 1])[:, None, :], 2))
    z = lse(ahead[np.arange(many), ends] + pairs[:, 0], 1)
    p = np.exp(np.minimum(0.0, ahead + after - z[:, None, None]))
    node = (np.eye(3)[tags] - p) * real[:, :, None]
    inner = real[:, 1:]
    between = np.exp(np.minimum(0.0, ahead[:, :-1, :, None] + pairs + (rows[:, 1:] + after[:, 1:])[:, :, None, :] - z[:, None, None, None]))
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[:, :-1][inner], tags[:, 1:][inner]), 1.0)
    np.add.at(seen, (np.zeros(many, int), tags[:, 0]), 1.0)
    np.add.at(seen, (tags[np.arange(many), ends], np.zeros(many, int)), 1.0)
    edge = seen - (between * inner[:, :, None, None]).sum(axis=(0, 1))
    edge[0] -= p[:, 0].sum(axis=0)
    edge[:, 0] -= p[np.arange(many), ends].sum(axis=0)
    return node, edge


def labelled_runs(text: str) -> list[str]:
    """Training runs of a text: all its tokens, by line feeds, each its tag and features by spaces.

    A run has RUN_TOKENS tokens, and more where it would end within a secret.
    """
    secrets: list[tuple[int, int]] = []
    for a, b in sorted(_secret_ranges(text)):
        if secrets and a < secrets[-1][1]:
            secrets[-1] = (secrets[-1][0], max(b, secrets[-1][1]))
        else:
            secrets.append((a, b))
    spots = [m.span() for m in _TOKEN.finditer(text)]
    tags, at, last = [], 0, None
    for a, b in spots:
        while at < len(secrets) and secrets[at][1] <= a:
            at += 1
        hit = at if at < len(secrets) and secrets[at][0] < b else None
        tags.append(0 if hit is None else 2 if hit == last else 1)
        last = hit
    lines = [f"{t} {' '.join(f)}" for t, f in zip(tags, features([text[a:b] for a, b in spots], file_features(text)))]
    out, at = [], 0
    while at < len(lines):
        end = at + RUN_TOKENS
        while end < len(lines) and tags[end] == 2:
            end += 1
        out.append("\n".join(lines[at:end]))
        at = end
    return out


def made_runs(words: list[str], n: int = MADE_RUNS, seed: int = 7) -> list[str]:
    """Training runs as of labelled_runs: a made key, or a look-alike, among plain words."""
    import random

    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = (letters + letters.upper() + digits, letters + letters.upper() + digits, letters + digits, letters.upper() + digits, letters + letters.upper(), letters + letters.upper() + digits + "+/", letters + letters.upper() + digits + "-_")
    names = ("key", "api key", "access key", "secret key", "client_secret", "credential", "credentials", "pwd", "pass", "passphrase", "auth", "authorization", "bearer", "private key", "signing key", "token", "password", "access_token", "conn", "login", "license key", "session", "webhook", "encryption_key", "db_pass", "app.secret")
    plain = [w for w in words if w.isalpha()] or ["the", "house", "river", "people"]

    def text(k: int) -> list[str]:
        return [rng.choice(plain) for _ in range(k)]

    def run_of(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    def key() -> str:
        kind = rng.random()
        body = run_of(rng.choice(alphabets), 16, 48)
        if kind < 0.3:
            return run_of(letters, 2, 5) + rng.choice("_-") + (run_of(letters, 3, 4) + rng.choice("_-") if rng.random() < 0.4 else "") + body
        if kind < 0.4:
            return "eyJ" + body + "." + run_of(alphabets[0], 16, 40) + "." + run_of(alphabets[6], 16, 30)
        return body + ("=" * rng.randint(1, 2) if kind > 0.9 else "")

    def like() -> str:
        """A long token that is no key."""
        w = rng.choice
        kind = rng.randrange(10)
        if kind == 0:
            return "https://" + ".".join(text(2)) + "/" + "/".join(text(3)).lower()
        if kind == 1:
            return "".join(x.capitalize() for x in text(rng.randint(3, 5)))
        if kind == 2:
            return "_".join(text(rng.randint(3, 5))).lower()
        if kind == 3:
            return "-".join(text(rng.randint(2, 5)))
        if kind == 4:
            return f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:00Z"
        if kind == 5:
            return f"{w(plain)}.{w(plain)}@{w(plain)}.com".lower()
        if kind == 6:
            return "".join(text(3)).lower()
        if kind == 7:
            return run_of(digits, 8, 20)
        if kind == 8:
            return "-".join(run_of(digits + "abcdef", k, k) for k in (8, 4, 4, 4, 12))
        return f"{w(plain)}={rng.randint(0, 99999)}"

    out = []
    for _ in range(n):
        before, after = text(rng.randint(0, 14)), text(rng.randint(0, 14))
        if rng.random() < 0.45:
            tokens = [*before, like(), *text(rng.randint(0, 5)), *([rng.choice(names)] if rng.random() < 0.4 else []), *text(rng.randint(1, 3)), like(), *after]
            tokens = [t for x in tokens for t in x.split(" ")]
            tags = [0] * len(tokens)
        else:
            name, value = rng.choice(names), key()
            name = rng.choice((name, name.upper(), name.title(), name.replace(" ", "_"), name.replace("_", "-")))
            quote = rng.choice(("", "", "'", '"'))
            value = quote + value + quote + rng.choice(("", "", "", ",", ";", "."))
            form = rng.randrange(7)
            joined = name.replace(" ", "_")
            middle = [[*name.split(" "), value], [*name.split(" "), "=", value], [f"{joined}={value}"], [*f"{name}:".split(" "), value], [f'"{joined}":', value], ["-H", "'Authorization:", "Bearer", value], [value]][form]
            tokens = [*before, *middle, *after]
            at = len(before) + len(middle) - 1
            tags = [int(i == at) for i in range(len(tokens))]
        file = [rng.choice(("f=0", "f=1", "f=2", "f=3")), rng.choice(("fcode", "ftext"))]
        out.append("\n".join(f"{t} {' '.join(f)}" for t, f in zip(tags, features(tokens, file))))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field trained on the SAMPLE_ROWS rows of docs with the smallest hashed ids, and on made runs.

    Null ids are not sampled; without any row the field is trained on the made
    runs alone. The order of training depends on the ids only, of whatever type.
    """
    ids = [r[0] for r in docs.select(F.col(id_col).alias("i")).filter("i IS NOT NULL").orderBy(F.xxhash64("i"), "i").limit(SAMPLE_ROWS).collect()]
    spark, runs, words = docs.sparkSession, [], []
    if ids:
        sample = spark.createDataFrame([(i,) for i in ids], f"i {dict(docs.dtypes)[id_col]}").distinct()
        rows = common.id_and_text(docs, id_col, text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("i"), "left_semi")
        found = common.map_texts(rows, lambda: lambda texts: [(labelled_runs(t), _TOKEN.findall(t[:400])[:8]) for t in texts], "runs array<string>, words array<string>")
        found = common.saved(found, "labelled")
        every = found.select("doc_id", F.posexplode("runs").alias("at", "run")).dropDuplicates(["doc_id", "at"]).withColumns({"is_secret": F.expr("run rlike '(^|\n)1 '"), "turn": F.xxhash64("doc_id", "at")})
        # All runs with a secret come first, then others by a hash of their place; only the chosen ones' features travel.
        chosen = every.select("doc_id", "at", "is_secret", "turn").orderBy(F.desc("is_secret"), "turn", "doc_id", "at").limit(SAMPLE_RUNS).select("doc_id", "at")
        picked = every.join(F.broadcast(chosen), ["doc_id", "at"]).select("run", "turn", "at").collect()
        runs = [r.run for r in sorted(picked, key=lambda r: (r.turn, r.at))]
        words = [r.w for r in found.select(F.explode("words").alias("w")).filter("length(w) BETWEEN 2 AND 14").distinct().orderBy(F.xxhash64("w"), "w").limit(2000).collect()]
        common.discard(found)
    made = made_runs(words)
    step = max(1, len(runs) // max(1, len(made)))
    both = [x for i, m in enumerate(made) for x in (*runs[i * step : (i + 1) * step], m)] + runs[len(made) * step :]
    return train([[(int(x[0]), x[2:].split(" ")) for x in run.split("\n")] for run in both])


class Decoder:
    """Viterbi over every token of texts.

    A token's scores are a sum over its shape, its neighbours' classes and its
    file, so shape and class are kept per word, and the sums of many texts are
    made at once. A stretch of tokens can be other than O only if that gains over
    O; `gain` bounds what a token gives from above, whatever the tags beside it,
    so tokens in no stretch with a sum of 0 or more are O in every best path.
    Viterbi runs on the others, with the same tags as over the whole text.
    """

    def __init__(self, field: Field):
        self.field, w, pairs = field, field.weights, field.pairs
        none = [0.0, 0.0, 0.0]
        self.near = {side: np.array([w.get(side + c, none) for c in _CLASSES]) for side in ("p", "pp", "n")}
        self.file = {f: np.array(w.get(f, none)) for f in ("f=0", "f=1", "f=2", "f=3", "fcode", "ftext")}
        end = max(0.0, pairs[1][0] - pairs[0][0], pairs[2][0] - pairs[0][0])
        self.plain: dict[tuple, tuple] = {}
        self.bound = [max(p[t] for p in pairs) - pairs[0][0] + end for t in (1, 2)]
        self.reset()

    def reset(self) -> None:
        decoder = self

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                return decoder.add(word)

        # Number 0 is the empty word beyond both ends of a text.
        self.words, self.held, self.rows, self.kind = Words(), 0, np.zeros((4096, 3)), np.zeros(4096, np.int8)
        self.words[b""] = 0

    def add(self, word: bytes) -> int:
        at = self.words[word] = len(self.words)
        if at == len(self.rows):
            self.rows, self.kind = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.kind, np.zeros_like(self.kind)])
        text = word.decode()
        core = text.strip(_AROUND)
        if core.isalpha() and (core.islower() or core[1:].islower()):
            # Of a plain word all features follow from these, so words alike share one computation.
            key = (len(core), len(core.translate(_NO_VOWELS)), core.isascii() and not core.strip(_HEX_DIGITS), core.isascii(), bool(_KEY.search(core)))
            if key not in self.plain:
                self.plain[key] = self.field.scores([shape(text)])[0], _CLASSES.index(_beside(text))
            self.rows[at], self.kind[at] = self.plain[key]
        else:
            self.rows[at] = self.field.scores([shape(text)])[0]
            self.kind[at] = _CLASSES.index(_beside(text))
        self.held += len(word) + 200
        return at

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Per text the secrets that the field tags, without quotes and marks around them."""
        out: list[list[tuple[int, int]]] = []
        batch, n = [], 0
        for text in texts:
            batch.append((text, text.encode().split()))  # bytes split at the white space of WORD
            n += len(batch[-1][1])
            if n >= BATCH_TOKENS:
                out += self._batch(batch)
                batch, n = [], 0
        return out + self._batch(batch)

    def _batch(self, batch: list) -> list[list[tuple[int, int]]]:
        if self.held > CACHE_BYTES:
            self.reset()
        ids, firsts = [], []
        for _, words in batch:
            ids += (0, 0)
            firsts.append(len(ids))
            ids += map(self.words.__getitem__, words)
            ids.append(0)
        out: list[list[tuple[int, int]]] = [[] for _ in batch]
        if not batch:
            return out
        at = np.array(ids)
        kind = self.kind[at]
        rows = self.rows[at]
        rows[1:] += self.near["p"][kind[:-1]]
        rows[2:] += self.near["pp"][kind[:-2]]
        rows[:-1] += self.near["n"][kind[1:]]
        files = np.array([sum(self.file[f] for f in file_features(text)) for text, _ in batch])
        rows += np.repeat(files, [len(words) + 3 for _, words in batch], axis=0)
        gain = np.maximum(rows[:, 1] + self.bound[0], rows[:, 2] + self.bound[1]) - rows[:, 0]
        gain[at == 0] = -1.0
        hot = np.unique(np.searchsorted(firsts, np.flatnonzero(gain >= -1e-6), "right") - 1)
        for i in hot.tolist():
            text, words = batch[i]
            a, b = firsts[i], firsts[i] + len(words)
            out[i] = self._text(text, rows[a:b], gain[a:b])
        return out

    def _text(self, text: str, rows, gain) -> list[tuple[int, int]]:
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        low, high = np.minimum.accumulate(sums[:-1]), np.maximum.accumulate(sums[:0:-1])[::-1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], high - low >= -1e-6, [False]])))
        tagged: list[list[int]] = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            for k, tag in enumerate(self.field.decode(rows[a:b].tolist()), a):
                if tag == 1:
                    tagged.append([k, k])
                elif tag == 2:
                    tagged[-1][1] = k
        if not tagged:
            return []
        spots, out = [m.span() for m in _TOKEN.finditer(text)], []
        for i, k in tagged:
            a, b = spots[i][0], spots[k][1]
            core = text[a:b]
            a += len(core) - len(core.lstrip(_TRIM + "."))
            b -= len(core) - len(core.rstrip(_TRIM + "."))
            if a < b and i == k:
                a += text[a:b].find(_value(text[a:b]))
            if a < b:
                out.append((a, b))
        return out


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Secrets that the field tags, without quotes and marks around them."""
    return Decoder(field).spans([text])[0]


def scan(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<struct<kind, start, end>> by start.

    Kinds: the base patterns, and `field` for what the field finds where no base
    span lies. Offsets are code points, end exclusive. Null and empty texts have
    no spans; repeated rows are scanned alike; other columns are dropped.
    """
    field = field or fit(docs, id_col, text_col)
    weights, pairs = {k: v for k, v in field.weights.items()}, field.pairs
    order = {k: i for i, k in enumerate((*KINDS, "field"))}

    def make():
        own = Decoder(Field(weights, pairs))

        def work(text, found):
            out = base_spans(text)
            for a, b in found:
                if not any(x < b and a < y for _, x, y in out):
                    out.append(("field", a, b))
            out.sort(key=lambda x: (x[1], order[x[0]]))
            return ([dict(zip(("kind", "start", "end"), s)) for s in out],)

        return lambda texts: [work(t, f) for t, f in zip(texts, own.spans(texts))]

    return common.map_texts(common.id_and_text(docs, id_col, text_col), make, f"spans {SPANS}")


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return scan(common.documents(spark, sf_dir)).select("doc_id", *digest("spans", KINDS))
