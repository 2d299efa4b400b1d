"""Plain single-machine versions of the corpus operators, written from their definitions."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    found = WORD.findall(az(text))
    if not found:
        return 0
    spans = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    marks = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def components(rows, reach=2):
    """(doc_id, hex mark, smallest doc_id reachable) by all pairs of distinct marks."""
    marks = sorted({m for _, m in rows})
    parent = {m: m for m in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            if (a ^ b).bit_count() <= reach:
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for d, m in rows:
        if d is not None:
            low[find(m)].append(d)
    return [(d, f"{m:016x}", min(low[find(m)], default=None)) for d, m in rows]


def contamination(docs, items, window=13):
    """(doc_id, n_words, n_hit, n_items, digest, contaminated) per document, with spans."""
    phrases = defaultdict(set)
    for item, text in items:
        found = ALNUM.findall(az(text))
        for i in range(max(1, len(found) - window + 1) if found else 0):
            phrases[tuple(found[i : i + window])].update(() if item is None else (str(item),))
    widths = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        found = ALNUM.findall(az(text))
        hit, held = set(), set()
        for i in range(len(found)):
            for w in widths:
                p = tuple(found[i : i + w])
                if len(p) == w and p in phrases:
                    hit.update(range(i, i + w))
                    held |= phrases[p]
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out.append((doc, len(found), len(hit), len(held), digest, bool(hit) and 20 * len(hit) >= len(found)))
    return out


def figures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    n, r = len(found), len(covered)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def water(sizes, weights=(5, 2, 1), limit=3):
    """Target of each source, the excess shared again one round at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(limit * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        more = {s for s in open_ if share[s] > limit * sizes[s]}
        if not more:
            return {s: limit * sizes[s] if s in full else share[s] for s in names}
        full |= more


def tokens(docs, path):
    """(doc_id, start, n_tokens, crc) in ascending doc_id order."""
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, []
    for doc, text in sorted(docs, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def repeated_lines(docs, run=3, long=50):
    """{doc_id: (lines, line numbers to delete)}: lines of windows whose content came before, three lines or fewer with 50 words."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if WORD.search(x)]
        gone = set()
        for s in range(len(lines)):
            for e in range(s + 1, min(len(lines), s + run) + 1):
                w = tuple(x for _, x in lines[s:e])
                if e - s == run or sum(len(WORD.findall(x)) for x in w) >= long:
                    if w in seen:
                        gone.update(i for i, _ in lines[s:e])
                    seen.add(w)
        out[doc] = (len(lines), sorted(gone))
    return out


def repeated_sentences(docs, span=2, least=30, long=50):
    """{doc_id: (sentences, numbers to remove)}: sentences in a repeated span.

    A span has two sentences and 30 words, and would not if it lost its first or if it lost its last; or is one of 50 words.
    """
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        parts = [p for line in (text or "").split("\n") for p in re.split(r"(?<=[.!?])(?=[ \t\r\x0b\x0c])", line)]
        parts = [WORD.findall(az(p)) for p in parts]
        parts = [p for p in parts if p]
        before = [0]
        for p in parts:
            before.append(before[-1] + len(p))

        def fits(s, e):
            return e - s >= span and before[e] - before[s] >= least

        gone = set()
        for s in range(len(parts)):
            for e in range(s + 1, len(parts) + 1):
                if fits(s, e) and (not fits(s, e - 1) or not fits(s + 1, e)) or e - s == 1 and len(parts[s]) >= long:
                    w = tuple(map(tuple, parts[s:e]))
                    if w in seen:
                        gone.update(range(s, e))
                    seen.add(w)
                if fits(s + 1, e):
                    break  # longer ones can lose an end
        out[doc] = (len(parts), sorted(gone))
    return out


def chat(turns, tools):
    """(conv_id, turn, part, kind, call_id, name, status, call_turn) of every item, one conversation after another.

    ``tools`` has a function for each tool that says whether it takes the arguments.
    """
    items, out = defaultdict(list), []
    for conv, turn, role, text in turns:
        try:
            value = json.loads(text) if text and text.lstrip()[:1] == "{" else None
        except ValueError:
            value = None
        found = []
        if value and role == "assistant" and isinstance(value.get("tool_calls"), list):
            if value.get("content"):
                found.append(("message", None, None, None))
            for call in value["tool_calls"]:
                inner = call.get("function", call)
                args = inner.get("arguments")
                if isinstance(args, str):
                    try:
                        args = json.loads(args)
                    except ValueError:
                        pass
                found.append(("call", call.get("id"), inner.get("name"), args))
        elif value and role in ("tool", "function") and "tool_call_id" in value:
            found.append(("result", value["tool_call_id"], None, None))
        for part, x in enumerate(found or [("message", None, None, None)]):
            items[conv].append((turn, part, *x))
    for conv, every in items.items():
        first = {}
        for turn, part, kind, call, name, _ in sorted(every, key=lambda x: x[:2]):
            if kind == "call" and call is not None and conv is not None:
                first.setdefault(call, (turn, part, name))
        answered = {x[3] for x in every if x[2] == "result"}
        for turn, part, kind, call, name, args in every:
            status, at = "ok", first.get(call) if kind != "message" else None
            if kind == "call":
                good = name in tools and tools[name](args)
                status = "duplicate_id" if at and at[:2] != (turn, part) else "unknown_tool" if name not in tools else None if not good else "ok" if at and call in answered else "unanswered"
            elif kind == "result":
                status, name = ("ok", at[2]) if at else ("orphan", None)
            out.append((conv, turn, part, kind, call, name, status, at[0] if at else None))
    return out


def licences(docs, best, share, named):
    """(doc_id, licence, origin, inherited_from): nearest directory above with a licence file, for documents without a licence of their own.

    ``best`` has each document's licence, ``share`` whether its licence text is most of it, ``named`` whether its path is a licence file's.
    """
    held = {}
    for doc, path in sorted(docs, key=lambda x: (x[1], best[x[0]] or "")):
        if best[doc] and (share[doc] or named[doc]):
            held.setdefault("/".join(path.split("/")[:-1]), best[doc])
    out = []
    for doc, path in docs:
        parts, found, where = path.split("/")[:-1], best[doc], None
        for n in range(len(parts), -1, -1):
            if found is None and "/".join(parts[:n]) in held:
                where = "/".join(parts[:n])
                found = held[where]
        out.append((doc, found, "header" if best[doc] else "inherited" if found else "none", where))
    return out
