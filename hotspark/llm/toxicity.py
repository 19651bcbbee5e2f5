"""Toxicity: Levenshtein automata over a lexicon trie, and scores of the hits' surroundings.

The lexicon is learned: terms are words, and stems of words, that labelled toxic texts
hold far more often than others. They form a trie. A Levenshtein automaton walks the
trie with every word of a text at once: a state is the set of trie nodes that the letters
so far reach with up to so many edits, and equal sets are one state, so the intersection
of automaton and trie is a table that numpy steps through, letter by letter, for all
words of a batch. A hit counts by its surroundings: quoted or reported words less, words
said to somebody more. A logistic regression on a few such sums gives the score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from hotspark.llm.kernels import buffers, map_texts, steps
from hotspark.session import materialize

#: Labelled texts that training takes at most for each label value, about; half make the lexicon, half the weights.
SAMPLE_PER_LABEL = 2000
#: Letters a term has at least; letters from which one edit and two edits are allowed.
LEAST, ONE_EDIT, TWO_EDITS = 4, 5, 9
#: A term's log odds, less so many standard errors of the largest chance value among all candidates, reach at
#: least LEAST_ODDS; a term with edits needs so much of the best term's; terms of the lexicon at most.
ERRORS, LEAST_ODDS, FUZZY_SHARE, TERMS = 0.5, 0.7, 0.5, 2000
#: Words on either side of a hit that belong to its surroundings.
WINDOW = 6
#: What a hit counts inside a quotation or quoted line, near a word of reporting, and with each edit.
QUOTED, REPORTED, EDITED = 0.2, 0.5, 0.8
# Words that report speech, and words that address somebody.
REPORTING = "said says wrote writes called calls quoted quote word words term insult insults sagte sagt schrieb nannte wort dit écrit appelé mot dijo dice escribió llamó palabra".split()
ADDRESS = "you your yours youre u ur yourself du dich dir dein deine ihr euch tu te toi ton vous votre tú ti tus usted eres".split()
#: Strength with which the weights are held at their first values, and these: bias, all hits, misspelled, quoted, said to somebody.
RIDGE = 0.5
PRIOR = np.array([-3.0, 3.0, 0.0, 0.3, 0.5])

_LETTER, _MARK, _OPEN, _CLOSE, _STRAIGHT = 1, 2, 3, 4, 5


def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """The lower-case form and the kind of each code point: letters, marks that hide letters, quotation marks."""
    n = 0x110000
    lower, kind = np.arange(n, dtype=np.int32), np.zeros(n, np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalpha():
            kind[c] = _LETTER
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    for ch in "*@$!#%+0123456789":
        kind[ord(ch)] = _MARK
    for opening, closing in ("«»", "‹›", "“”", "„‟"):
        kind[ord(opening)], kind[ord(closing)] = _OPEN, _CLOSE
    kind[ord('"')] = _STRAIGHT
    return lower, kind


_tables: list = []


def _points() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables.extend(_code_points())
    return _tables[0], _tables[1]


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows, and row offsets into them; what is not UTF-8 is replaced."""
    start = (data & 0xC0) != 0x80
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        return points, np.concatenate([[0], np.cumsum(start)])[offs]
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs, offs[1:])]
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


class Words:
    """The words of some rows: runs of letters, with hiding marks between letters, in lower case."""

    def __init__(self, points: np.ndarray, offs: np.ndarray):
        lower, kinds = _points()
        self.points, self.kind = lower[points], kinds[points]
        n = len(points)
        letter = self.kind == _LETTER
        row_start = np.zeros(n + 1, bool)
        row_start[offs] = True
        # a mark belongs to a word if a letter stands on either side of it, in the same row
        inside = np.zeros(n, bool)
        if n > 2:
            inside[1:-1] = (self.kind[1:-1] == _MARK) & letter[:-2] & letter[2:] & ~row_start[1:n - 1] & ~row_start[2:n]
        word = letter | inside
        edge = np.zeros(n + 1, bool)
        edge[1:n] = word[1:] != word[:-1]
        edge[[0, n]] = True
        edge |= row_start
        at = np.flatnonzero(edge)
        first, last = at[:-1], at[1:]
        keep = word[first] if n else np.zeros(0, bool)
        self.first, self.last, self.offs = first[keep], last[keep], offs
        self.woffs = np.searchsorted(self.first, offs)

    def text(self, i: int) -> str:
        return self.points[self.first[i]:self.last[i]].astype(np.uint32).tobytes().decode("utf-32-le")

    def texts(self) -> list[str]:
        whole = self.points.astype(np.uint32).tobytes().decode("utf-32-le")
        return [whole[a:b] for a, b in zip(self.first.tolist(), self.last.tolist())]


class Lexicon:
    """Terms as a trie, intersected with Levenshtein automata; the table of states grows as words need it."""

    def __init__(self, terms: list[tuple[str, bool, float]], ordinary: frozenset[str] = frozenset()):
        """Terms are (letters, whether any ending may follow, weight); `ordinary` words are no misspellings."""
        self.terms = sorted(terms)
        self.ordinary = ordinary
        self.sure = FUZZY_SHARE * max((w for _, _, w in terms), default=0.0)
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[int, bool] | None] = [None]
        for k, (letters_, stem, _) in enumerate(self.terms):
            node = 0
            for ch in letters_:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                node = self.next[node][ch]
            if self.end[node] is None or stem:
                self.end[node] = (k, stem)
        # the most edits that any term below a node allows
        self.edits = [0] * len(self.next)
        for node in range(len(self.next) - 1, -1, -1):
            own = max((self.edits[c] for c in self.next[node].values()), default=0)
            if self.end[node]:
                own = max(own, self._allowed(self.end[node][0]))
            self.edits[node] = own
        symbols = sorted({ch for letters_, _, _ in self.terms for ch in letters_})
        self.symbols = np.zeros(0x110000, np.int16)
        for i, ch in enumerate(symbols):
            self.symbols[ord(ch)] = i + 1
        self.names = [""] + symbols
        self.sets: list[dict[int, int]] = []
        self.number: dict[tuple, int] = {}
        self.table = np.full((64, len(self.names)), -1, np.int32)
        # for each state the term it ends, the edits to it, and the stem it completes, or -1
        self.ends = np.full((64, 3), -1, np.int32)
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))
        self.weights = np.array([w for _, _, w in self.terms] or [0.0])

    def _allowed(self, term: int) -> int:
        """Edits that a term allows: none for stems, short words and weak terms."""
        letters_, stem, weight = self.terms[term]
        return 0 if stem or len(letters_) < ONE_EDIT or weight < self.sure else 2 if len(letters_) >= TWO_EDITS else 1

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes that leaving out letters of terms reaches; nodes without enough edits left go."""
        work = list(state.items())
        out = {n: e for n, e in work if e <= self.edits[n]}
        while work:
            node, e = work.pop()
            for child in self.next[node].values():
                if e + 1 <= self.edits[child] and out.get(child, 99) > e + 1:
                    out[child] = e + 1
                    work.append((child, e + 1))
        return out

    def _state(self, nodes: dict[int, int]) -> int:
        key = tuple(sorted(nodes.items()))
        if key in self.number:
            return self.number[key]
        k = self.number[key] = len(self.sets)
        self.sets.append(nodes)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.ends = np.concatenate([self.ends, np.full_like(self.ends, -1)])
        ends = [(e, self.end[n][0]) for n, e in nodes.items() if self.end[n] and e <= self._allowed(self.end[n][0])]
        e, term = min(ends, default=(-1, -1))
        stem = max((self.end[n][0] for n, e in nodes.items() if e == 0 and self.end[n] and self.end[n][1]), default=-1)
        self.ends[k] = term, e, stem
        return k

    def _expand(self, state: int, symbol: int) -> int:
        ch = self.names[symbol]
        out: dict[int, int] = {}

        def reach(node, e):
            if e <= self.edits[node] and out.get(node, 99) > e:
                out[node] = e

        for node, e in self.sets[state].items():
            reach(node, e + 1)  # a letter too many
            for c, child in self.next[node].items():
                reach(child, e if c == ch else e + 1)  # the letter, or another in its place
        self.table[state, symbol] = k = self._state(self._closed(out))
        return k

    def find(self, points: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that hit a term: their numbers, the term with the fewest edits (then the smallest), and the edits."""
        symbol = self.symbols[points]
        state = np.full(len(first), self.start, np.int32)
        stems = np.full(len(first), -1, np.int32)
        live = np.arange(len(first))
        at = 0
        while len(live):
            s, c = state[live], symbol[first[live] + at]
            to = self.table[s, c]
            new = to < 0
            if new.any():
                width = len(self.names)
                for key in np.unique(s[new].astype(np.int64) * width + c[new]).tolist():
                    self._expand(key // width, key % width)
                to = self.table[s, c]
            state[live] = to
            stem = self.ends[to, 2]
            found = (stem >= 0) & (stems[live] < 0)
            stems[live[found]] = stem[found]
            at += 1
            live = live[(to != self.dead) & (last[live] - first[live] > at)]
        term, edits = self.ends[state, 0], self.ends[state, 1]
        use = (stems >= 0) & (edits != 0)
        term = np.where(use, stems, term)
        edits = np.where(use, 0, edits)
        at = np.flatnonzero(term >= 0)
        if self.ordinary and len(at):
            fuzzy = np.flatnonzero(edits[at] > 0)
            names = [points[first[i]:last[i]].astype(np.uint32).tobytes().decode("utf-32-le") for i in at[fuzzy].tolist()]
            drop = np.zeros(len(at), bool)
            drop[fuzzy] = [w in self.ordinary for w in names]
            at = at[~drop]
        return at, term[at], edits[at]


def quoted(words: Words) -> np.ndarray:
    """Whether each code point lies in a quotation, between marks of one line, or in a line quoted with >."""
    n = len(words.points)
    if not n:
        return np.zeros(0, bool)
    newline = words.points == 10
    start = np.zeros(n + 1, bool)
    start[words.offs] = True
    start[1:] |= newline
    line = np.cumsum(start[:n]) - 1
    lines = np.flatnonzero(start[:n])

    def before(flag):
        """Flags of the line before each code point, and of the whole line."""
        total = np.concatenate([[0], np.cumsum(flag)])
        ends = np.append(lines[1:], n)
        return total[:n] - total[lines][line], (total[ends] - total[lines])[line]

    straight, all_straight = before(words.kind == _STRAIGHT)
    opens, _ = before(words.kind == _OPEN)
    closes, all_closes = before(words.kind == _CLOSE)
    marked = words.points[lines] == ord(">")
    return ((straight % 2 == 1) & (all_straight > straight)) | ((opens > closes) & (all_closes > closes)) | marked[line]


def _cues(words: Words, cues: list[str]) -> np.ndarray:
    """Whether each word is one of a few short words."""
    out = np.zeros(len(words.first), bool)
    size = words.last - words.first
    for cue in cues:
        may = np.flatnonzero(size == len(cue))
        for k, ch in enumerate(cue):
            may = may[words.points[words.first[may] + k] == ord(ch)]
        out[may] = True
    return out


def surroundings(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hit: whether it is quoted, and whether its window holds a word of reporting, and of address."""
    rows = np.searchsorted(words.woffs, at, side="right") - 1
    low, high = np.maximum(at - WINDOW, words.woffs[rows]), np.minimum(at + WINDOW + 1, words.woffs[rows + 1])
    # only words inside some window are looked at
    near = np.zeros(len(words.first) + 1, np.int64)
    np.add.at(near, low, 1)
    np.add.at(near, high, -1)
    looked = np.flatnonzero(np.cumsum(near)[:-1] > 0)
    part = Words.__new__(Words)
    part.points, part.first, part.last = words.points, words.first[looked], words.last[looked]
    out = []
    for cues in (REPORTING, ADDRESS):
        total = np.zeros(len(words.first) + 1, np.int64)
        flag = np.zeros(len(words.first), np.int64)
        flag[looked] = _cues(part, cues)
        np.cumsum(flag, out=total[1:])
        out.append(total[high] > total[low])
    return quoted(words)[words.first[at]], out[0], out[1]


def features(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """A row of features and a number of hits for each text."""
    points, offs = letters(data, offs)
    words = Words(points, offs)
    n = len(offs) - 1
    out = np.zeros((n, len(PRIOR)))
    out[:, 0] = 1
    at, term, edits = lexicon.find(words.points, words.first, words.last)
    if not len(at):
        return out, np.zeros(n, np.int64)
    rows = np.searchsorted(words.woffs, at, side="right") - 1
    inside, reported, addressed = surroundings(words, at)
    weight = lexicon.weights[term] * EDITED ** edits
    direct = weight * np.where(inside, QUOTED, 1.0) * np.where(reported, REPORTED, 1.0)
    for k, value in ((1, direct), (2, direct * (edits > 0)), (3, weight - direct), (4, direct * addressed)):
        out[:, k] = np.log1p(np.bincount(rows, value, minlength=n))
    return out, np.bincount(rows, minlength=n)


class Model:
    """A lexicon and the weights of the features."""

    def __init__(self, lexicon: Lexicon | None = None, weights: np.ndarray = PRIOR):
        self.lexicon = lexicon or Lexicon([])
        self.weights = weights

    def scores(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1, and hits, for each row."""
        x, hits = features(data, offs, self.lexicon)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -35, 35))), hits


def learn_terms(toxic: list[list[str]], clean: list[list[str]]) -> list[tuple[str, bool, float]]:
    """Words and stems that toxic texts hold far more often: the shortest such stem, lengthened while it loses no text."""
    if not toxic:
        return []
    n1, n0 = len(toxic), max(1, len(clean))

    def counted(texts, known=None):
        words, stems = Counter(), Counter()
        for text in texts:
            own = {w for w in text if len(w) >= LEAST}
            words.update(own if known is None else own & known[0].keys())
            cut = {w[:k] for w in own for k in range(LEAST, min(len(w), 12) + 1)}
            stems.update(cut if known is None else cut & known[1].keys())
        return words, stems

    words1, stems1 = counted(toxic)
    words1 = Counter({w: c for w, c in words1.items() if c >= 2})
    stems1 = Counter({s: c for s, c in stems1.items() if c >= 2})
    words0, stems0 = counted(clean, (words1, stems1))

    def odds(c1, c0):
        value = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))
        return value - errors * math.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))

    errors = ERRORS * math.sqrt(2 * math.log(2 + len(words1) + len(stems1)))
    good = {s: odds(c, stems0[s]) for s, c in stems1.items()}
    good = {s: v for s, v in good.items() if v >= LEAST_ODDS}
    inner: dict[str, list[str]] = {}
    for s in stems1:
        inner.setdefault(s[:-1], []).append(s)
    terms, seen = {}, set()
    for s in sorted(good, key=lambda x: (len(x), x)):
        if any(s[:k] in seen for k in range(LEAST, len(s))):
            continue
        seen.add(s)
        # down to where the words part or end
        while True:
            longer = [t for t in inner.get(s, ()) if stems1[t] >= 0.9 * stems1[s]]
            if not longer or words1[s] >= 0.5 * stems1[s]:
                break
            s = longer[0]
        whole = words1[s] >= 0.5 * stems1[s] or len(s) >= 12
        low = odds(words1[s], words0[s]) if whole and words1[s] else odds(stems1[s], stems0[s])
        if low >= LEAST_ODDS:
            terms[s, not whole] = low
    for w, c in words1.items():
        low = odds(c, words0[w])
        if low >= LEAST_ODDS and not any((w[:k], True) in terms for k in range(LEAST, len(w) + 1)):
            terms[w, False] = low
    best = sorted(terms.items(), key=lambda x: (-x[1], x[0]))[:TERMS]
    return [(w, stem, v) for (w, stem), v in best]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, held at PRIOR by a ridge; with one label only, PRIOR."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + RIDGE * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def learn(texts: list[bytes], labels: list[int]) -> Model:
    """Even places make the lexicon, odd ones the weights; words of clean texts of the first half are no misspellings."""
    split: list[list[list[str]]] = [[], []]
    for text, y in list(zip(texts, labels))[::2]:
        split[y].append(Words(*letters(*_pack([text]))).texts())
    terms = learn_terms(split[1], split[0])
    seen = sorted({w for text in split[0] for w in text if len(w) >= ONE_EDIT - 1})
    points = np.frombuffer("".join(seen).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in seen]).astype(np.int64)
    hit = Lexicon(terms).find(points, np.append(0, ends)[:-1], ends)[0]
    lexicon = Lexicon(terms, frozenset(seen[i] for i in hit.tolist()))
    data, offs = _pack(texts[1::2])
    rows = [features(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], lexicon)[0] for i, j in steps(offs)]
    weights = fit(np.concatenate(rows), np.array(labels[1::2], float)) if rows else PRIOR
    return Model(lexicon, weights)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_label: int = SAMPLE_PER_LABEL) -> Model:
    """A model from a bounded sample: about `per_label` labelled rows of each label, drawn by a hash of the key.

    Keys without a label, labels other than 0 and 1 and null keys are left out; null
    texts count as empty. Without labelled texts the lexicon is empty and every score low.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 20
    part = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(parts))
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (part < max(1, round(parts * min(1.0, per_label / n)))))
    drawn = materialize(rows.where(keep), "drawn")
    texts = docs.select(F.col(key).alias("k"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"))
    sample = sorted((r["y"], r["k"], bytes(r["t"])) for r in texts.join(drawn, "k").select("k", "y", "t").toLocalIterator())
    return learn([t for _, _, t in sample], [y for y, _, _ in sample])


def classify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Kept columns, score (0 to 1), predicted (1 if score >= threshold) and hits (words that matched a term).

    A null or empty text, or one without hits, is scored by the bias alone; equal texts
    get equal scores; a text of any length is read whole; an empty table gives an empty
    one; kept columns with the new names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("hits", T.LongType())]

    def make():
        m = shared.value

        def run(column):
            data, offs = buffers(column)
            parts = [m.scores(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]) for i, j in steps(offs)]
            s = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
            h = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(h.astype(np.int64))]

        return run

    return map_texts(df, text, list(keep if keep is not None else df.columns), fields, make)
