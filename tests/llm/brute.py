"""Plain versions of the contracts, row by row."""
from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def op1(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    many = Counter(grams)
    under = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(under), len(w) < 50 or 100 * len(under) > 50 * len(w)


def shingle_set(text: str | None, size: int = 4) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else ({tuple(w)} if w else set())


def op2(rows: list[tuple[int, str | None]], percent: int = 85, size: int = 4) -> dict[int, tuple[int, int]]:
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            m, n = len(sets[a]), len(sets[b])
            if m and n and 100 * min(m, n) >= percent * max(m, n):
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (m + n - same):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def op3(rows: list[tuple[int, str | None]], encode) -> dict[int, tuple[int, int, int]]:
    out, at = {}, 0
    for i, t in sorted(rows):
        ids = [*encode(t or ""), 2]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def op7(text: str | None, items: list[tuple[int, str | None]]) -> tuple:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, its in items:
        p = word.findall((its or "").translate(LOWER))
        for k in range(max(1, len(p) - 12) if p else 0):
            window = p[k : k + 13]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def op8(text: str | None) -> tuple:
    spans = {k: [] for k in BASE}
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            spans[kind].append((m.start(), m.end()))
    listed = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in spans[k])
    return *(len(spans[k]) for k in BASE), sha(listed), listed


def op10(text: str | None, templates: dict[str, list[str]], least: float = 0.85) -> list[tuple[int, str, float]]:
    def grams(w: list[str]) -> Counter:
        return Counter(zip(w, w[1:])) if len(w) != 1 else Counter([(w[0], "")])

    def dice(a: list[str], b: list[str]) -> float:
        x, y = grams(a), grams(b)
        return 2 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0

    word = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
    lines = [word.findall(x.translate(LOWER)) for x in (text or "").split("\n")]
    w = [(x, n) for n, line in enumerate(lines, 1) for x in line]
    flat, held = [x for x, _ in w], [(name, word.findall(t.translate(LOWER))) for name in sorted(templates) for t in templates[name]]

    def best(unit: list[str]) -> tuple[str, float] | None:
        top = max(((dice(unit, t), -k) for k, (_, t) in enumerate(held)), default=(0.0, 0))
        return (held[-top[1]][0], top[0]) if top[0] >= least else None

    whole = best(flat) if len(lines) > 1 else None
    taken, at = [], 0
    for n, line in enumerate(lines, 1):
        if m := best(line):
            taken.append((n, at, at + len(line), *m))
        at += len(line)
    pool = []
    for k, (name, t) in enumerate(held):
        for i in range(len(flat) - len(t) + 1):
            if (d := dice(flat[i : i + len(t)], t)) >= least:
                pool.append((-(grams(flat[i : i + len(t)]) & grams(t)).total(), -d, i, k, i + len(t), name))
    found = list(taken)
    for _, d, i, _, end, name in sorted(pool):
        if not any(i < b and a < end and (other == name or e >= -d) for _, a, b, other, e in taken):
            taken.append((w[i][1], i, end, name, -d))
            if not whole or whole[0] != name:
                found.append(taken[-1])
    return ([(0, *whole)] if whole else []) + [(n, name, d) for n, _, _, name, d in sorted(found)]


def op8_contexts(texts: list[str | None], rounds: int = 8, least: float = 0.2, score: float = 0.8) -> list[list[tuple[int, int]]]:
    """Spans of kind context of each text, by plain loops over tokens, patterns and rounds."""
    import regex

    white = " \t\n\x0b\f\r"
    plain = lambda s: regex.sub(rf"[^\p{{L}}\p{{N}}{white}]+", "", s).lower().split()
    marked = lambda s: [regex.sub(f"[{white}]+", "", m) for m in regex.findall(rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}]++[{white}]*+[^\p{{L}}\p{{N}}{white}][^\p{{L}}\p{{N}}]*+", s.lower())]
    sides = {"pair": "left", "word": "left", "mark": "left", "next": "right", "shape": "shape", "class": "shape"}
    total, rows = Counter(), []
    for number, text in enumerate(texts):
        text = text or ""
        base = [tuple(map(int, x.split(":")[1:])) for x in op8(text)[5].split(",") if x]
        tokens = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if re.search("[0-9@]", m.group())]
        stream = ["^", "^"] + [w for m in re.finditer(r"[^\x20\x09-\x0D]+", text) for w in (["#"] if re.search("[0-9@]", m.group()) else plain(m.group()))]
        total.update(("word", w) for w in stream)
        total.update(("pair", f"{a} {b}") for a, b in zip(stream, stream[1:]))
        total.update(("mark", m) for m in marked(text))
        near, at = ["^", "^"], 0
        for k, m in enumerate(tokens):
            start, end, token, gap = m.start(), m.end(), m.group(), text[at : m.start()]
            near = (plain(gap)[::-1] + near)[:2]
            following = text[end : tokens[k + 1].start()] if k + 1 < len(tokens) else text[end:]
            seed = any(start <= s < end for s, _ in base)
            if seed or not any(s < end and e > start for s, e in base) and (len(re.sub("[^0-9]", "", token)) >= 6 or "@" in token):
                lead = gap + regex.match(r"[^\p{L}\p{N}]*", token).group()
                core = re.sub("[^A-Za-z0-9@.:-]+", "", token)
                runs = "".join(f"9x{len(r)}" if r[0].isdigit() else f"ax{len(r)}" if r[0].isalpha() else r for r in re.findall("[A-Za-z]+|[0-9]+|[@.:-]+", core))
                keys = {"pair": f"{near[1]} {near[0]}", "word": near[0], "mark": (marked(lead) or [None])[-1] if regex.search(rf"[^\p{{L}}\p{{N}}{white}][{white}]*\Z", lead) else None,
                        "next": (plain(following) or ["#" if k + 1 < len(tokens) else "$"])[0], "shape": runs,
                        "class": ("a9" if regex.search(r"\p{L}", token) else "9") + (" long" if len(core) >= 16 else " short")}
                keys = {f: x for f, x in keys.items() if x is not None and x not in ("#", "^", "$", "^ ^", "# #", "^ #")}
                rows.append((number, start, end, token, seed, keys))
            near, at = ["#", *near][:2], end
    times, seen, kinds, known = Counter(), Counter(), {}, {}
    for _, _, _, token, seed, keys in rows:
        known[token] = max(known.get(token, 0.0), float(seed))
        for p in keys.items():
            times[p, token] += 1
            seen[p] += 1
            kinds.setdefault(p, set()).add(token)
    of = lambda p: seen[p] if p[0] in ("shape", "class") else total[("word" if p[0] == "next" else p[0], p[1])]
    held = {p: max(seen[p], of(p)) for p, t in kinds.items() if len(t) > 1 and of(p) and seen[p] >= least * of(p)}
    weight = {key: known[key[1]] for key in times if key[0] in held}
    scored: dict = {}
    for _ in range(rounds):
        sums: Counter = Counter()
        for (p, token), w in weight.items():
            sums[p] += times[p, token] * w
        scored = {p: s / (held[p] + 2) for p, s in sums.items()}
        top: dict = {}
        for p, token in weight:
            spot = top.setdefault(token, dict.fromkeys(("left", "right", "shape"), 0.0))
            spot[sides[p[0]]] = max(spot[sides[p[0]]], scored[p])
        for p, token in weight:
            miss = 1 - known[token]
            for s, v in top[token].items():
                miss *= 1.0 if s == sides[p[0]] else 1 - v
            weight[p, token] = 1 - miss
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for number, start, end, _, seed, keys in rows:
        best = dict.fromkeys(("left", "right", "shape"), 0.0)
        for p in keys.items():
            best[sides[p[0]]] = max(best[sides[p[0]]], scored.get(p, 0.0))
        outside = (1 - best["left"]) * (1 - best["right"])
        if not seed and 1 - outside * (1 - best["shape"]) >= score and 1 - outside >= score / 2:
            out[number].append((start, end))
    return out
