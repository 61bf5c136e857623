"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from a bounded sample of labelled documents: words, and
stems that words begin with, that are far commoner in toxic ones. Its terms form
a trie. A state of the automaton is a set of (trie node, edits used) pairs, that
is, the intersection of all terms' Levenshtein automata with the trie; it is made
deterministic once, over the few character classes the lexicon tells apart, so a
word is matched against all terms, misspelt or not, by one table look-up per
character until no term is left in reach. All words of a batch advance together.

A hit's window holds the hits close by and whether it stands between a pair of
quotation marks that lie close enough together; a single mark quotes nothing. Windows give a document's features; a logistic model, fitted on the same
sample, weighs exact, misspelt, stem and quoted hits and their density.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, tidy, trim
from gymlake.llm.kernel import chunks
from gymlake.llm.quality_model import folds, labelled_sample

SAMPLE = 8000
STEMS = (4, 5, 6, 7, 8)
WINDOW = 10
#: Terms of one automaton.
GROUP = 8
#: Characters between two marks of a quotation, at most.
QUOTATION = 300
THRESHOLD = 0.7
QUOTES = "\"“”„«»"
SPACES = "\t\n\x0b\x0c\r "

EXACT, FUZZY, STEM = 1, 2, 3
CODES = 0x110000
BLANK, MARK, QUOTE, OTHER, FIRST = 0, 1, 2, 3, 4


def edits_for(term: str) -> int:
    """Edits allowed to a whole word: none under 5 letters, one under 9, then two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The class of every code point, letters of terms aside."""
    kinds = np.fromiter((OTHER if chr(c).isalnum() else MARK for c in range(CODES)), np.uint16, CODES)
    kinds[[ord(c) for c in SPACES]] = BLANK
    kinds[[ord(c) for c in QUOTES]] = QUOTE
    return kinds


@lru_cache(maxsize=64)
def _classes(letters: str) -> np.ndarray:
    classes = _kinds().copy()
    for i, ch in enumerate(letters):
        for form in {ch, ch.upper()}:
            if len(form) == 1:
                classes[ord(form)] = FIRST + i
    return classes


@dataclass
class Automaton:
    letters: str  # those that have a class of their own
    step: np.ndarray  # state, class to state; 0 is dead, 1 the start
    label: np.ndarray  # of a word that ends in the state
    caught: np.ndarray  # states that are a hit whatever follows
    harmless: frozenset = frozenset()  # lower-case words that are no misspelling of a term
    rest: tuple = ()  # automata of the other terms


def build_automaton(terms: list[tuple[str, bool]], harmless: Iterable[str] = ()) -> Automaton:
    """terms: (text, is_stem). A stem matches exactly, as the beginning of a word. A harmless word is no misspelling of a term.

    Terms may be in any script, of any length and number: each GROUP of them, in alphabetical order, has an automaton of its own,
    since the states of one grow faster than its terms.
    """
    ordered = sorted(set(terms))
    first, *rest = [_determinised(ordered[i : i + GROUP]) for i in range(0, len(ordered), GROUP)] or [_determinised([])]
    return replace(first, harmless=frozenset(harmless), rest=tuple(rest))


def _determinised(terms: list[tuple[str, bool]]) -> Automaton:
    children: list[dict[str, int]] = [{}]
    whole: list[int] = [-1]  # edits allowed to a word that ends here; -1: none does
    stem: list[bool] = [False]
    for term, is_stem in terms:
        node = 0
        for ch in term:
            if ch not in children[node]:
                children[node][ch] = len(children)
                children.append({})
                whole.append(-1)
                stem.append(False)
            node = children[node][ch]
        if is_stem:
            stem[node] = True
        else:
            whole[node] = edits_for(term)
    reach = list(whole)  # most edits of any word at or below a node; stems need 0
    for node in range(len(children) - 1, -1, -1):
        below = [reach[c] for c in children[node].values()] + ([0] if stem[node] else [])
        reach[node] = max([reach[node], *below])

    letters = "".join(sorted({ch for term, _ in terms for ch in term}))

    def close(pairs: set[tuple[int, int]]) -> frozenset:
        """Add what skipping letters of terms reaches; drop what an equal node with fewer edits covers."""
        best: dict[int, int] = {}
        queue = list(pairs)
        while queue:
            node, used = queue.pop()
            if used > reach[node] or best.get(node, 99) <= used:
                continue
            best[node] = used
            queue.extend((c, used + 1) for c in children[node].values())
        return frozenset(best.items())

    def advance(state: frozenset, ch: str | None) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, used in state:
            out.add((node, used + 1))  # a letter too many
            for own, child in children[node].items():
                out.add((child, used if own == ch else used + 1))
        return close(out)

    width = FIRST + len(letters)
    start = close({(0, 0)})
    numbers = {frozenset(): 0, start: 1} if start else {frozenset(): 0, None: 1}
    todo, rows = [start] if start else [], {0: [0] * width, 1: [0] * width}
    while todo:
        state = todo.pop()
        row = [0] * width
        other = advance(state, None)
        for k in range(width):
            after = advance(state, letters[k - FIRST]) if k >= FIRST else other if k != BLANK else frozenset()
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row[k] = numbers[after]
        rows[numbers[state]] = row
    label, caught = np.zeros(len(numbers), np.uint8), np.zeros(len(numbers), bool)
    for state, number in numbers.items():
        if not state:
            continue
        exact = any(used == 0 and whole[node] >= 0 for node, used in state)
        near = any(used <= whole[node] for node, used in state)
        caught[number] = any(used == 0 and stem[node] for node, used in state)
        label[number] = STEM if caught[number] else EXACT if exact else FUZZY if near else 0
    return Automaton(letters, np.array([rows[i] for i in range(len(numbers))], np.int32), label, caught)


#: Marks that open by their form, where blanks or marks are on both sides, as in « term ».
OPENING = "“„«"


def in_quotation(kind: np.ndarray, codes: np.ndarray, cuts: np.ndarray, place: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Whether places lie between an opening and a closing mark of one document with no other between, at most QUOTATION apart.

    A mark opens where a blank or mark is before it and none after, and closes the other way round; 5" does neither for what follows.
    With such on both sides its form decides.
    """
    marks = np.flatnonzero(kind == QUOTE)
    padded = np.concatenate([[BLANK], kind, [BLANK]])
    before, after = padded[marks] < OTHER, padded[marks + 2] < OTHER
    edge = np.isin(marks, cuts), np.isin(marks + 1, cuts)
    free, bound = before | edge[0], after | edge[1]
    opening = free & (~bound | np.isin(codes[marks], [ord(c) for c in OPENING]))
    opens, closes = marks[opening], marks[~opening]
    last_open, last_close = (np.append(x, -1)[np.searchsorted(x, place) - 1] for x in (opens, closes))
    next_open, next_close = (np.append(x, len(kind) + 2 * QUOTATION)[np.searchsorted(x, place)] for x in (opens, closes))
    inside = (last_open > last_close) & (next_close < next_open) & (next_close - last_open <= QUOTATION)
    return inside & (last_open >= cuts[document]) & (next_close < cuts[document + 1])


def find_hits(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, word number in the chunk, label, quoted) of each hit, and each document's first word number."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cuts = lead[offsets]
    kind = _kinds()[codes]
    blank = kind == BLANK
    edge = np.zeros(len(codes) + 1, bool)
    edge[cuts] = True
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])[: len(blank)] | ~blank & edge[:-1])
    after = np.concatenate([blank[1:], [True]])[: len(blank)] | edge[1:]
    ends = np.flatnonzero(~blank & after) + 1
    first = np.searchsorted(starts, cuts)
    inner = np.flatnonzero(kind >= OTHER)  # words without the marks around them
    lo, hi = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
    number = np.flatnonzero(hi > lo)
    begin, stop = inner[lo[number]], inner[hi[number] - 1] + 1
    begin_of, stop_of = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    begin_of[number], stop_of[number] = begin, stop
    found_word, found_label, found_at = [], [], []
    every = number, begin, stop
    for part in (automaton, *automaton.rest):
        number, at, stop = every
        state, own = np.ones(len(number), np.int32), _classes(part.letters)[codes]
        while len(number):
            state = part.step[state, own[at]]
            at = at + 1
            over = (at == stop) | part.caught[state]
            label = np.where(over, part.label[state], 0)
            hit = label > 0
            found_word.append(number[hit])
            found_label.append(label[hit])
            found_at.append(at[hit] - 1)
            go = ~over & (state > 0)
            number, state, at, stop = number[go], state[go], at[go], stop[go]
    word, label, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_word, found_label, found_at))
    order = np.lexsort((label, label == FUZZY, word))  # of several terms, one that the word holds exactly
    order = order[np.flatnonzero(np.diff(word[order], prepend=-1))]
    word, label, place = word[order], label[order], place[order]
    document = np.searchsorted(first, word, side="right") - 1
    if automaton.harmless:
        near = np.flatnonzero(label == FUZZY)
        known = [codes[begin_of[w] : stop_of[w]].astype("<u4").tobytes().decode("utf-32-le").lower() in automaton.harmless for w in word[near]]
        keep = np.ones(len(word), bool)
        keep[near] = ~np.array(known, bool)
        word, label, place, document = word[keep], label[keep], place[keep], document[keep]
    quoted = in_quotation(kind, codes, cuts, place, document)
    return document, word, label, quoted, first


FEATURES = 7
MISSPELT = 0.8


def features(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per document; no words or no hits: zeros."""
    document, word, label, quoted, first = find_hits(automaton, data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    if not len(document):
        return out
    size = np.diff(first)
    for column, chosen in enumerate(((label == EXACT) & ~quoted, (label == FUZZY) & ~quoted, (label == STEM) & ~quoted, quoted)):
        out[:, column] = np.log1p(np.bincount(document[chosen], minlength=n))
    # hits within WINDOW words on either side, in the same document
    lo = np.maximum(np.searchsorted(word, word - WINDOW), np.searchsorted(document, document))
    hi = np.minimum(np.searchsorted(word, word + WINDOW, side="right"), np.searchsorted(document, document, side="right"))
    window = np.log1p(hi - lo) * np.where(quoted, 0.3, 1.0)
    np.maximum.at(out[:, 4], document, window)
    direct = np.bincount(document[~quoted], minlength=n)
    out[:, 5] = np.log1p(1000 * direct / np.maximum(size, 1))
    out[:, 6] = direct > 0
    return out


def text_features(automaton: Automaton, texts: pa.Array) -> np.ndarray:
    parts = [features(automaton, data, offsets) for _, _, data, offsets in chunks(texts, 512 << 10)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def _trimmed(text: str) -> set[str]:
    out = set()
    for raw in text.lower().encode().split():
        word = raw.decode("utf-8", "replace")
        lo, hi = 0, len(word)
        while lo < hi and not word[lo].isalnum():
            lo += 1
        while hi > lo and not word[hi - 1].isalnum():
            hi -= 1
        if hi > lo:
            out.add(word[lo:hi])
    return out


def learn_lexicon(texts: list[str], labels: np.ndarray) -> list[tuple[str, bool]]:
    """All whole words and stems in many toxic and few other documents, the best first; none extends another. The sample bounds their number."""
    toxic, other = Counter(), Counter()
    candidates: set = set()
    positive = int(labels.sum())
    least = max(3, positive // 50)
    for text, label in zip(texts, labels, strict=True):
        if label:
            own = set()
            for word in _trimmed(text):
                own.add((word, False))
                own.update((word[:k], True) for k in STEMS if len(word) > k)
            toxic.update(own)
    candidates = {t for t, n in toxic.items() if n >= least}
    by_stem = defaultdict(bool)
    for text, _ in candidates:
        by_stem[text[:4]] = True
    for text, label in zip(texts, labels, strict=True):
        if not label:
            own = set()
            for word in _trimmed(text):
                if by_stem.get(word[:4]):
                    own.add((word, False))
                    own.update((word[:k], True) for k in STEMS if len(word) > k)
            other.update(own & candidates)
    odds = positive / max(len(texts) - positive, 1)
    worth = {t: toxic[t] - 3 * odds * other[t] for t in candidates}
    chosen: list[tuple[str, bool]] = []
    for t in sorted(candidates, key=lambda t: (-worth[t], t[1], -len(t[0]), t[0])):
        if worth[t] < max(least, 0.3 * toxic[t]):
            continue
        if not any(t[0].startswith(c[0]) or c[0].startswith(t[0]) for c in chosen):
            chosen.append(t)
    return chosen


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray
    bias: float


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def harmless_words(automaton: Automaton, texts: list[str]) -> list[str]:
    """Words of these texts that the automaton takes for misspelt terms."""
    seen: set[str] = set()
    for lo, hi, data, offsets in chunks(pa.array(texts, pa.string()), 1 << 20):
        document, word, label, _, first = find_hits(automaton, data, offsets)
        raw = [None] * (hi - lo)
        for d, w in zip(document[label == FUZZY], word[label == FUZZY], strict=True):
            if raw[d] is None:
                raw[d] = data[offsets[d] : offsets[d + 1]].tobytes().split()
            seen.update(_trimmed(raw[d][w - first[d]].decode("utf-8", "replace")))
    return sorted(seen)


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Lexicon, automaton and weights. Without toxic examples every score is the share of toxic labels (0 without any).

    A text that occurs several times in the sample counts once.
    """
    once = {t: i for i, t in reversed(list(enumerate(texts)))}
    labels = np.asarray(labels)[sorted(once.values())]
    texts = [texts[i] for i in sorted(once.values())]
    automaton = build_automaton([])
    if labels.sum():
        lexicon = learn_lexicon(texts, labels)
        automaton = build_automaton(lexicon)
        automaton = replace(automaton, harmless=frozenset(harmless_words(automaton, [t for t, y in zip(texts, labels, strict=True) if not y])))
    if not labels.sum():
        return Model(automaton, np.zeros(FEATURES), -40.0 if not len(labels) else float(np.log(0.5 / len(labels))))
    x = text_features(automaton, pa.array(texts, pa.string()))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    scale[FUZZY - 1], mean[FUZZY - 1] = scale[EXACT - 1], mean[EXACT - 1]
    z[:, FUZZY - 1] = 0
    z[:, EXACT - 1] = (x[:, EXACT - 1] + MISSPELT * x[:, FUZZY - 1] - mean[EXACT - 1]) / scale[EXACT - 1]  # misspelt hits are rare: tied to exact ones
    for _ in range(30):  # Newton's method on the ridge-penalised likelihood
        p = _sigmoid(z @ w)
        gradient = z.T @ (p - labels) + 0.5 * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    weights = w[:-1] / scale
    weights[FUZZY - 1], mean[FUZZY - 1] = MISSPELT * weights[EXACT - 1], 0.0
    return Model(automaton, weights, float(w[-1] - (weights * mean).sum()))


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    return _sigmoid(text_features(model.automaton, texts) @ model.weights + model.bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels outside the held-out fold (crc32 of doc_id mod 3 is 1), at most SAMPLE of them."""
    model = fit(*labelled_sample(docs, labels, "toxic", ~folds(1, 3), rows=SAMPLE))
    trim()
    return model


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. Null and empty texts score like texts without a hit.

    A null doc_id is not held out. Repeated rows are scored each. An empty table gives no rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score_texts(shared.value, batch.column(2)), pa.float64())], ["doc_id", "held_out", "score"])

    held = F.coalesce(folds(1, 3), F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
