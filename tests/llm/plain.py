"""Plain forms of operators, for comparison on small tables."""

import hashlib
import heapq
import re
import zlib


def plain_damaged(conv, rows):
    """rows (turn, role, text) of one conversation, damaged."""
    out = []
    shown = lambda v: " " if v is None else str(v)
    for turn, role, text in rows:
        role, text = shown(role), shown(text)
        harm = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def plain_repair(rows):
    """The report of one conversation: a search over all edits, cheapest first and then by initials."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    first = [r[1][:1] or " " for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    heap, done = [(0, "", 0, "", ())], {}
    best = None
    while heap:
        cost, audit, at, state, made = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(rows) and state in ("", "a"):
            best = best or (cost, audit, made)
            best = min(best, (cost, audit, made))
        # a place may be reached at one cost in several ways, of which none is dropped but the dearer ones
        if done.setdefault((at, state), cost) < cost:
            continue
        step = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", at, step, made + ((step, None),)))
        if at < len(rows):
            cut = faults[at] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, made))
            if faults[at] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, step, made + ((step, at),)))
                if first[at] == step or (state == "" and first[at] == "s"):
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, first[at], made + (("", at),)))
    cost, audit, made = best
    names = {"u": "user", "a": "assistant"}
    lines = [f"{names.get(role) or rows[at][1]}:{'' if at is None else rows[at][2]}" for role, at in made]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
