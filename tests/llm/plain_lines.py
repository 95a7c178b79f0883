"""Line dedup by its definition, in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _key(doc):
    return (2**63 - 1 if doc[0] is None else doc[0], hashlib.md5((doc[1] or "").encode()).hexdigest())


def _lines(text):
    """(number, line, words) of the lines with words."""
    return [(no, x, n) for no, x in enumerate((text or "").split("\n")) if (n := len(WORD.findall(x)))]


def cut_stretch(stretch, links):
    """Chunks of a stretch: cut at weaker links, where the rolled hash says so, and after 64 lines."""
    chunks, segment = [], []
    for j, x in enumerate(stretch):
        before, after = links[j - 1] if j else 0, links[j + 1] if j + 1 < len(links) else 0
        if links[j] < before or links[j] < after:
            segment = []
        rolled = 0
        for back, h in enumerate(reversed(segment[-3:])):
            rolled ^= (h << back | h >> 32 - back) & 0xFFFFFFFF
        if not j or len(segment) % 64 == 0 or rolled % 4 == 0:
            chunks.append([])
        chunks[-1].append(x)
        segment.append(int(hashlib.sha256(x[1].encode()).hexdigest()[:8], 16))
    return chunks


def plain_passages(docs, most=50):
    """{key: (text, chunks gone, lines gone, lines gone by windows alone)}."""
    pairs, long = Counter(), Counter()
    for d in docs:
        lines = _lines(d[1])
        pairs.update((a[1], b[1]) for a, b in zip(lines, lines[1:]))
        long.update(x[1] for x in lines if x[2] > most)
    texts = {_key(d): d[1] for d in docs}
    stretches = []
    for key, text in texts.items():
        lines, open_stretch = _lines(text), None
        links = [0] + [n if (n := pairs[a[1], b[1]]) > 1 else 0 for a, b in zip(lines, lines[1:])]
        for k, x in enumerate(lines):
            if not links[k]:
                starts = (k + 1 < len(lines) and links[k + 1]) or (x[2] > most and long[x[1]] > 1)
                open_stretch = ([], []) if starts else None
                if starts:
                    stretches.append((key, *open_stretch))
            if open_stretch:
                open_stretch[0].append(x)
                open_stretch[1].append(links[k])
    stretches = [s for s in stretches if sum(x[2] for x in s[1]) > most]

    first = {}
    cuts = [cut_stretch(s, links) for _, s, links in stretches]
    for (key, _, _), chunks in zip(stretches, cuts):
        for c in chunks:
            same, place = tuple(x[1] for x in c), (*key, c[0][0])
            first[same] = min(place, first.get(same, place))
    gone, by_chunk, n_chunks = defaultdict(set), defaultdict(set), Counter()
    for (key, _, _), chunks in zip(stretches, cuts):
        island = []
        for c in [*chunks, None]:
            if c and first[tuple(x[1] for x in c)] < (*key, c[0][0]):
                island.append(c)
                continue
            if sum(x[2] for y in island for x in y) > most:
                n_chunks[key] += len(island)
                by_chunk[key] |= set(range(island[0][0][0], island[-1][-1][0] + 1))
            island = []

    first, windows = {}, []
    for key, s, _ in stretches:
        for run in least_windows(s, most):
            same, place = tuple(x[1] for x in run), (*key, run[0][0])
            first[same] = min(place, first.get(same, place))
            windows.append((key, same, run))
    for key, same, run in windows:
        if first[same] < (*key, run[0][0]) and any(x[0] not in by_chunk[key] for x in run):
            gone[key] |= set(range(run[0][0], run[-1][0] + 1))
    out = {}
    for key, text in texts.items():
        removed = gone[key] | by_chunk[key]
        left = None if text is None else "\n".join(x for no, x in enumerate(text.split("\n")) if no not in removed)
        out[key] = (left, n_chunks[key], len(removed), len(removed - by_chunk[key]))
    return out


def least_windows(lines, most):
    """The shortest runs of over ``most`` words that begin, and that end, with each line."""
    for rows, turn in ((lines, 1), (lines[::-1], -1)):
        b = words = 0
        for a in range(len(rows)):
            while b < len(rows) and words <= most:
                words += rows[b][2]
                b += 1
            if words <= most:
                break
            yield rows[a:b][::turn]
            words -= rows[a][2]


def plain_rows(docs, most=50):
    """(doc_id, text, chunks, lines, lines by windows alone) of each row, sorted."""
    found = plain_passages(docs, most)
    return sorted([(str(d[0]), *found[_key(d)]) for d in docs], key=str)
