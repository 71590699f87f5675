"""Conversations whose messages quote each other, and the links that a walk over them finds."""

import itertools
import random
import re
import textwrap


def conversations(n, seed=1, vocabulary=5000, turns=12):
    """(conv_id, turn, role, text) rows, and the turn that each message was made to quote (or None).

    A quote is a whole message, a paragraph, a line, some lines wrapped anew, or a part of a line; it may hold the quoted
    message's own quote one level deeper, and stands below an attribution of one line, two lines or none.
    """
    rng = random.Random(seed)
    rows, meant = [], {}
    for conv in range(n):
        said = []
        for turn in range(turns):
            up = rng.randrange(turn) if turn and rng.random() < 0.7 else None
            quote = _quote(rng, said[up]) if up is not None else []
            paragraphs = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(8, 60))) for _ in range(rng.randrange(1, 4))]
            body = "\n\n".join(textwrap.fill(p, rng.randrange(30, 60)) for p in paragraphs)
            said.append((body, quote))
            rows.append((conv, turn, rng.choice("ub"), "\n".join([*quote, body])))
            meant[conv, turn] = up
    return rows, meant


def _quote(rng, message):
    body, deeper = message
    kind = rng.randrange(5)
    paragraph = rng.choice(body.split("\n\n"))
    lines = paragraph.split("\n")
    if kind == 0:
        lines = body.split("\n")
    elif kind == 2:
        lines = [rng.choice(lines)]
    elif kind == 3:
        low = rng.randrange(len(lines))
        lines = textwrap.wrap(" ".join(lines[low : low + 3]), 23)
    elif kind == 4:
        words = rng.choice(lines).split()
        low = rng.randrange(max(1, len(words) - 2))
        lines = [" ".join(words[low : low + rng.randrange(2, 7)])]
    lead = rng.choice([[], ["On Mon, Ann Smith wrote:"], ["On Mon, 3 May 2021 at 10:00, Ann Smith", "<ann@example.org> wrote:"]])
    mark = rng.choice(["> ", ">", " > "])
    return [*lead, *(f"> {x}" for x in deeper if rng.random() < 0.9 and kind == 0), *(mark + x for x in lines)]


def _words(text):
    return re.findall(r"[^\W_]+", text.lower())


def _lines(text):
    out = []
    for line in re.split(r"\r\n|\n|\r", text):
        marks = re.match(r"(?:[ \t]*>)+", line)
        out.append((marks[0].count(">") if marks else 0, line[marks.end() if marks else 0 :].strip(" ")))
    drop = set()
    for i, (level, line) in enumerate(out):
        below = out[i + 1][0] if i + 1 < len(out) else 0
        if below > level and re.search(r"(?i)^(on )?.* (wrote|writes|schrieb|escribió|a écrit)[^:]{0,60}:$", line):
            drop.add(i)
        two_below = out[i + 2][0] if i + 2 < len(out) else 0
        if below == level < two_below and re.search(r"(?i)^(on|am|le|el) [^!?]{0,120}[^.!?:]$", line):
            if re.search(r"(?i)^([^!?]{0,120} )?(wrote|writes|schrieb|escribió|a écrit)[^:]{0,60}:$", out[i + 1][1]):
                drop |= {i, i + 1}
    return [(level, line, i in drop) for i, (level, line) in enumerate(out)]


def _grams(words, size):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def walk(rows):
    """(conv_id, turn) -> reply_to, root, depth, position, n_quotes, n_linked, max_level, body; each turn once, no nulls."""
    found = {}
    for conv, messages in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        spoken = []  # turn, keys of what was said whole, words
        replies = {}
        for _, turn, _, text in messages:
            lines = _lines(text)
            own = [line for level, line, drop in lines if level == 0 and not drop]
            body = "\n".join(own)
            passages = set()
            for level, run in itertools.groupby(lines, key=lambda x: x[0]):
                kept = [line for _, line, drop in run if not drop]
                if level and kept:
                    passages.add((level, "\n".join(kept)))
            score, n_quotes, n_linked, top = {}, 0, 0, 0
            for level, passage in passages:
                units = {u for u in (passage, *passage.split("\n")) if _words(u)}
                if not units:
                    continue
                n_quotes, top, links = n_quotes + 1, max(top, level), []
                for unit in units:
                    links += [(t, len(unit)) for t, keys, _ in spoken if tuple(_words(unit)) in keys][:1]
                words = _words(passage)
                if not links and len(words) > 1:
                    size = min(5, len(words))
                    grams, met = _grams(words, size), {}
                    for g in grams:
                        for t, _, w in spoken:
                            if g in _grams(w, size):
                                met[t] = met.get(t, 0) + 1
                                break
                    links = [(t, len(passage) * n // len(grams)) for t, n in met.items() if 2 * n >= len(grams)]
                n_linked += bool(links)
                for t, chars in links:
                    score[level, t] = score.get((level, t), 0) + chars
            best = max(((-level, chars, t) for (level, t), chars in score.items()), default=(0, 0, None))[2]
            replies[turn] = best
            root, depth = turn, 0
            while replies[root] is not None:
                root, depth = replies[root], depth + 1
            found[conv, turn] = (best, root, depth, n_quotes, n_linked, top, body.strip())
            said = [body, *re.split(r"\n\s*\n", body)]
            units = {u for part in said for u in (part, *part.split("\n"))}
            spoken.append((turn, {tuple(_words(u)) for u in units}, _words(body)))
    return found
