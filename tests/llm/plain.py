"""Plain-Python versions of the contracts, for comparison on small tables."""

import collections
import fractions
import hashlib
import re
import zlib

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact(rows):
    """id, text to id: (keep_id, group_size, kept, sha256) for unique ids."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    return {i: (min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), sha(normal(t))) for i, t in rows}


def secret_spans(text):
    text, out = text or "", []
    for m in re.finditer("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10 == 0


def pii_spans(text):
    text = text or ""
    number = lambda x: re.sub("[^0-9]", "", x)
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(number(m[0])) <= 19 and luhn(number(m[0]))]
    return out + [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(number(m[0])) <= 15]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(grams)
    again = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def near(rows, n, percent):
    """id: (number of shingles, smallest id reachable)."""
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def repeats(rows):
    """id: (n_bytes, n_removed, n_spans, sha256 of what is left); rows in corpus order."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(w)
        out[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """source: target, by refilling until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def mix(rows, whole=False):
    """rows (u, id, size, source, tie) to {(id, tie): taken}, in the order of u within a source."""
    by = collections.defaultdict(list)
    for row in rows:
        by[row[3]].append(row)
    goal = targets({s: sum(r[2] for r in x) for s, x in by.items()})
    out = {}
    for s, x in by.items():
        total = sum(r[2] for r in x)
        full = int(goal[s] // total) if total else 0
        rest = int(goal[s]) - full * total if total else 0
        for _, i, size, _, tie in sorted(x):
            part = max(0, min(size, rest))
            rest -= size
            if whole:
                part = size if size and 2 * part >= size else 0
            out[i, tie] = full * size + part
    return out, goal


def shards(rows, n):
    """rows (u, id, crc, size, source) to {id: (shard, slot)}: ranks within sources, interleaved and cut."""
    by = collections.defaultdict(list)
    for row in rows:
        by[row[4]].append(row)
    ranked = [((r + 0.5) / len(x), s is None, s or "", row) for s, x in by.items() for r, row in enumerate(sorted(x, key=lambda y: y[:4]))]
    out, slots = {}, collections.Counter()
    for at, (_, _, _, row) in enumerate(sorted(ranked, key=lambda y: (y[0], y[1], y[2], y[3][:4]))):
        shard = at * n // len(ranked)
        out[row[1]] = (shard, slots[shard])
        slots[shard] += 1
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def planted(doc_id, text):
    """Words of a document after the contract's periods are planted."""
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def periods(words, least=24, times=3):
    """(start, length, period) of every run, by comparing the words with their own shift by each period."""
    number: dict = {}
    ids, out = np.array([number.setdefault(w, len(number)) for w in words]), {}
    for q in range(1, len(words) // times + 1):
        same = np.diff(np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]]))
        for i, j in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_row(words):
    """The contract's columns but doc_id."""
    runs = periods(words)
    best = min(runs, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(collapsed(words, runs)))


def damage(rows):
    """rows (conv_id, turn, role, text) after the contract's damage."""
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """Least (cost, audit, repaired) of turns (role, text, must go, truncated), by trying every edit from the end back."""
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    best = {s: (0, "", ()) if s in ("", "a") else (10**9, "", ()) for s in steps}

    def insertions(best):
        for _ in range(3):  # more than two insertions in a row lead nowhere new
            old = dict(best)
            for s in steps:
                best[s] = min([old[s]] + [(old[to][0] + 5, "I" + old[to][1], ((names[r], ""), *old[to][2])) for r, to in steps[s].items() if r in names])
        return best

    best = insertions(best)
    for role, text, gone, cut in reversed(turns):
        new = {}
        for s in steps:
            ways = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
            if not gone:
                for r, to in steps[s].items():
                    cost, audit, rest = best[to]
                    if r == role[:1]:
                        ways.append((cost + 5 * cut, "K" + audit, ((role, text), *rest)))
                    if r in names:
                        ways.append((cost + 5 * cut + 1, "R" + audit, ((names[r], text), *rest)))
            new[s] = min(ways)
        best = insertions(new)
    return best[""]


def repairs(rows):
    """conv_id: the contract's columns; rows are as given."""
    out = {}
    damaged_rows = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged_rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        at, seen, counts, turns = [r[1] for r in mine if r[1] is not None], set(), [0, 0, 0], []
        for _, _, role, text in mine:
            blank = not WORDS.search(text)
            again = not blank and (role, text) in seen
            cut = not blank and not again and WORDS.findall(text)[-1][-1] not in ".!?"
            seen.add((role, text))
            counts = [a + b for a, b in zip(counts, (blank, again, cut))]
            turns.append((role, text, blank or again, cut))
        cost, audit, fixed = cheapest(turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in fixed)))
    return out


def walk_digits(text, moves, classes, records, slots, period):
    """Digits of a text's fingerprint, one step of the walk after the other."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) & mask
        x = ((x ^ (x >> 27)) * 0x81DADEF4BC2DD44D) & mask
        return x ^ (x >> 33)

    stands = []
    for i, c in enumerate(text):
        stands += [i] * int(moves[classes[ord(c)], len(stands) % period])
    out = []
    for slot in range(slots):
        step = max((int(r) for r in records[slot] if r < len(stands)), default=None)
        gram = 0
        for k in range(4 if step is not None else 0):
            at = stands[step] + k
            gram = mix((gram * 0x9E3779B97F4A7C15 + (ord(text[at]) + 1 if at < len(text) else 0)) & mask)
        out.append(mix((gram + step * 0xD6E8FEB86659FD93) & mask) >> 60 if step is not None else 0)
    return out
