"""Secret scans: rules label credentials, inferred probabilistic automata find more of the same formats."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonegrid.llm.common import whole

#: Kinds in the order of the rules.
KINDS = ("assign", "access", "hex")
#: Fixed patterns of the rules. The last two hold the least length, which is the same as dropping shorter runs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: A maximal run of credential characters; of 16 and more, it is a candidate of the automata whatever its marks.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LONG = 16
#: Least length of a labelled credential.
SHORT = 6

#: Symbols of the automata: digits, hexadecimal and other letters of either case, and the marks themselves.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "+": "+", "/": "/", "_": "_", ".": ".", "=": "=", "-": "-"}
TO_CLASS = str.maketrans({c: k for k, chars in CLASSES.items() for c in chars})
SYMBOLS = {k: i for i, k in enumerate(CLASSES)}
END = "$"
MARKS = "+/_.=-"
PIECE = re.compile(f"[^{re.escape(MARKS)}]+")

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def rule_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the rules, leftmost without overlap per kind, in code points."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):  # the other two lie inside such runs
        for kind, rule in (("access", ACCESS), ("hex", HEX)):
            found += [(kind, m.start(), m.end(), m[0]) for m in rule.finditer(text, run.start(), run.end())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@functools.cache
def runs_of(least: int) -> re.Pattern:
    """Maximal runs of so many credential characters."""
    return re.compile(rf"[A-Za-z0-9+/_.=-]{{{least},}}")


def rests(text: str, spans: list[tuple[str, int, int, str]], least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of what the spans leave of every run, where it has the least length."""
    i, ends = 0, list(itertools.accumulate((s[2] for s in spans), max))
    for m in runs_of(least).finditer(text):
        a, end = m.span()
        while i < len(spans) and ends[i] <= a:
            i += 1
        for _, start, stop, _ in itertools.takewhile(lambda s: s[1] < end, itertools.islice(spans, i, None)):
            if start - a >= least:
                yield a, start
            a = max(a, stop)
        if end - a >= least:
            yield a, end


def add_pairs(pairs: Counter, words: Counter) -> None:
    """Count the class pairs of words and of their pieces between marks, by length (LONG stands for all from there)."""
    for word, n in words.items():
        for part in {m.span(): m[0] for m in [re.match(".*", word), *PIECE.finditer(word)]}.values():
            if len(part) >= SHORT:
                for pair in map("".join, itertools.pairwise(END + part + END)):
                    pairs[min(len(part), LONG), pair] += n


class Automaton:
    """A deterministic probabilistic automaton over symbols: per state its visits, its ends and its arcs."""

    def __init__(self, words: dict[str, int]):
        """The prefix tree of the labelled words with their counts."""
        self.visits, self.ends, self.owner = [0], [0], [0]
        self.arcs: list[dict[str, list[int]]] = [{}]  # symbol -> [state, visits]
        for word, n in sorted(words.items()):
            state = 0
            self.visits[0] += n
            for symbol in word:
                arc = self.arcs[state].get(symbol)
                if arc is None:
                    arc = self.arcs[state][symbol] = [len(self.visits), 0]
                    self.visits.append(0)
                    self.ends.append(0)
                    self.owner.append(len(self.arcs))
                    self.arcs.append({})
                arc[1] += n
                state = arc[0]
                self.visits[state] += n
            self.ends[state] += n

    def find(self, state: int) -> int:
        while self.owner[state] != state:
            self.owner[state] = state = self.owner[self.owner[state]]
        return state

    def alike(self, a: int, b: int, alpha: float) -> bool:
        """Hoeffding bounds hold for ends and arcs of both states and of all that follows them."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        todo, seen = [(a, b)], set()
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self.visits[a], self.visits[b]
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for symbol in self.arcs[a].keys() | self.arcs[b].keys():
                x, y = self.arcs[a].get(symbol), self.arcs[b].get(symbol)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > bound:
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def merge(self, a: int, b: int) -> None:
        """Fold b into a, and what follows where the arcs have the same symbol."""
        todo = [(a, b)]
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b:
                continue
            self.owner[b] = a
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for symbol, (to, n) in self.arcs[b].items():
                own = self.arcs[a].get(symbol)
                if own:
                    own[1] += n
                    todo.append((own[0], to))
                else:
                    self.arcs[a][symbol] = [to, n]

    def infer(self, alpha: float) -> None:
        """Merge states of one depth first, so that lengths keep their evidence, then states of different depths."""
        level = [0]
        order = [0]
        while level:
            nxt: list[int] = []
            for state in dict.fromkeys(map(self.find, level)):
                for symbol in sorted(self.arcs[state]):
                    to = self.find(self.arcs[state][symbol][0])
                    if to not in nxt:
                        nxt.append(to)
            kept: list[int] = []
            for state in sorted(nxt, key=lambda s: (-self.visits[s], s)):
                twin = next((k for k in kept if self.alike(k, state, alpha)), None)
                if twin is None:
                    kept.append(state)
                else:
                    self.merge(twin, state)
            level = [s for s in kept if self.find(s) == s]
            order += level
        red: list[int] = []
        for state in order:
            if self.find(state) != state or state in red:
                continue
            twin = next((r for r in red if self.find(r) == r and self.alike(r, state, alpha)), None)
            if twin is None:
                red.append(state)
            else:
                self.merge(twin, state)

    def table(self, words: dict[str, int]) -> dict:
        """Log-probabilities in nats, counted by running the words through the merged states."""
        names: dict[int, int] = {}
        arcs: Counter = Counter()
        ends: Counter = Counter()
        to_of: dict = {}
        for word, n in words.items():
            state = self.find(0)
            for symbol in word:
                to = self.find(self.arcs[state][symbol][0])
                arcs[state, symbol] += n
                to_of[state, symbol] = to
                state = to
            ends[state] += n
        for state, _ in [*arcs, *((s, "") for s in ends)]:
            names.setdefault(state, len(names))
        total = Counter()
        for (state, _), n in arcs.items():
            total[state] += n
        for state, n in ends.items():
            total[state] += n
        size = len(CLASSES) + 1
        return {
            "start": names.get(self.find(0), 0),
            # symbol -> (next state, log-probability of one of its characters)
            "arcs": [{symbol: (names[to_of[s, symbol]], math.log((n + 0.1) / (total[s] + 0.1 * size)) - math.log(len(CLASSES[symbol]))) for (s, symbol), n in arcs.items() if names[s] == i} for i in range(len(names))],
            "ends": [math.log((ends[s] + 0.1) / (total[s] + 0.1 * size)) for s in names],
            "lost": [math.log(0.1 / (total[s] + 0.1 * size)) for s in names],
        }


def likelihood(table: dict, word: str) -> float:
    """Log-likelihood of a class word; an arc never seen costs its smoothing mass and keeps the state."""
    state, total = table["start"], 0.0
    for symbol in word:
        arc = table["arcs"][state].get(symbol)
        if arc:
            state = arc[0]
            total += arc[1]
        else:
            total += table["lost"][state] - math.log(len(CLASSES[symbol]))
    return total + table["ends"][state]


def plain_table(counts: dict[str, int]) -> dict:
    """Chain of class pairs over ordinary runs, as an automaton with one state per last class."""
    after: Counter = Counter()
    for pair, n in counts.items():
        after[pair[0]] += n
    states = [END, *CLASSES]
    size = len(CLASSES) + 1
    prob = lambda a, b: math.log((counts.get(a + b, 0) + 0.1) / (after[a] + 0.1 * size))
    return {
        "start": 0,
        "arcs": [{k: (i + 1, prob(s, k) - math.log(len(CLASSES[k]))) for i, k in enumerate(CLASSES)} for s in states],
        "ends": [prob(s, END) for s in states],
        "lost": [0.0] * len(states),
    }


def smallest(hashes: dict[str, str], most: int) -> dict[str, str]:
    """The entries of the ``most`` smallest hashes."""
    return dict(sorted(hashes.items(), key=lambda e: (e[1], e[0]))[:most])


def learn_formats(docs: DataFrame, text_col: str = "text", max_examples: int = 400, alpha: float = 0.01) -> dict:
    """Infer one automaton per kind from the credentials that the rules label.

    The rules run over all documents; of each kind the ``max_examples`` different credentials of smallest hash are kept,
    by each task first and then of what the tasks kept. Each prefix tree is merged into a probabilistic automaton. All
    ordinary runs and their pieces, of the shortest of these credentials or of LONG characters at least, give the chain
    they are compared with; their number to that of the labels of a kind is the ``prior`` against it. A kind without
    labels gets no automaton. The result is a small plain table: at most max_examples x longest credential states.
    """

    def run(batches):
        plain: Counter = Counter()
        words: Counter = Counter()
        labels: Counter = Counter()
        kept: dict[str, dict[str, str]] = {kind: {} for kind in KINDS}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = rule_spans(text)
                for kind, _, _, value in spans:
                    labels[kind] += 1
                    if value not in kept[kind]:
                        kept[kind][value] = hashlib.blake2b(value.encode(), digest_size=8).hexdigest()
                        if len(kept[kind]) >= 2 * max_examples + 100:
                            kept[kind] = smallest(kept[kind], max_examples)
                words.update(text[a:b].translate(TO_CLASS) for a, b in rests(text, spans, SHORT))
            if len(words) > 100_000:
                add_pairs(plain, words)
                words.clear()
        add_pairs(plain, words)
        rows = [(f"{END}{length}", pair, "", n) for (length, pair), n in plain.items()]
        rows += [(END, kind, "", n) for kind, n in labels.items()]
        rows += [(kind, value, h, 0) for kind in KINDS for value, h in smallest(kept[kind], max_examples).items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "value", "h", "n"), r, strict=True)) for r in rows], pa.schema([("kind", pa.string()), ("value", pa.string()), ("h", pa.string()), ("n", pa.int64())]))

    texts = docs.select(whole(F.col(text_col)).alias("_text"))
    seen = texts.mapInArrow(run, "kind string, value string, h string, n long").groupBy("kind", "value", "h").agg(F.sum("n").alias("n"))
    by_hash = Window.partitionBy("kind").orderBy("h", "value")
    # one bound for all kinds, the pairs of classes included, so that Spark cuts the groups before they are dealt by kind
    most = max(max_examples, (len(CLASSES) + 1) ** 2)
    rows = seen.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= most).collect()
    labelled = {kind: [r["value"] for r in rows if r["kind"] == kind and r["k"] <= max_examples] for kind in KINDS}
    labels = {r["value"]: r["n"] for r in rows if r["kind"] == END}
    shortest = min((len(v) for values in labelled.values() for v in values), default=LONG)
    pairs: Counter = Counter()
    for r in rows:
        if r["kind"][0] == END and r["kind"] != END and int(r["kind"][1:]) >= min(shortest, LONG):
            pairs[r["value"]] += r["n"]
    plain = plain_table(pairs)
    ordinary = sum(n for pair, n in pairs.items() if pair[0] == END)
    kinds = {}
    for kind in KINDS:
        words: Counter = Counter(value.translate(TO_CLASS) for value in labelled[kind])
        if not words:
            continue
        tree = Automaton(words)
        tree.infer(alpha)
        table = tree.table(words)
        rates = sorted(likelihood(table, w) / len(w) for w in words)
        # as likely as all but the least likely hundredth of the labelled credentials
        kinds[kind] = table | {"least": rates[len(rates) // 100] - 1e-9, "shortest": min(map(len, words)), "longest": max(map(len, words)), "prior": math.log(max(1.0, ordinary / labels[kind]))}
    return {"kinds": kinds, "plain": plain}


def likely_parts(word: str, formats: dict, margin: float) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the parts of a class word that an automaton finds likely, the best without overlap.

    Parts are the word, its pieces between marks, and neighbouring pieces with the marks between and around them up to
    the longest labelled credential. All but a whole word of LONG characters must also outweigh the prior.
    """
    size = len(word)
    cuts = [0, *(i for i in range(1, size) if word[i] in MARKS or word[i - 1] in MARKS), size]
    stops = set(cuts)
    found: dict[tuple[int, int], tuple[float, str]] = {}

    def offer(kind: str, a: int, b: int, of: float) -> None:
        if of / (b - a) >= formats["kinds"][kind]["least"] and ((a, b) not in found or of > found[a, b][0]):
            found[a, b] = of, kind

    for kind, table in formats["kinds"].items():
        lo, hi = table["shortest"], table["longest"]
        for a in cuts[:-1]:
            state, of = table["start"], 0.0
            for b in range(a, min(size, a + hi)) if size - a >= lo else ():
                arc = table["arcs"][state].get(word[b])
                if arc:
                    state = arc[0]
                    of += arc[1]
                else:
                    of += table["lost"][state] - math.log(len(CLASSES[word[b]]))
                if of < table["least"] * hi:  # no longer part can make up for it
                    break
                if b + 1 in stops and b + 1 - a >= lo:
                    offer(kind, a, b + 1, of + table["ends"][state])
        longer = {(a, b) for a, b in [(0, size), *(m.span() for m in PIECE.finditer(word))] if b - a > hi}
        for a, b in longer | ({(0, size)} if LONG <= size < lo else set()):
            offer(kind, a, b, likelihood(table, word[a:b]))
    good = []
    for (a, b), (of, kind) in found.items():
        score = of - likelihood(formats["plain"], word[a:b])
        if score >= margin + (0.0 if b - a == size >= LONG else formats["kinds"][kind]["prior"]):
            good.append((kind, a, b, score))
    taken: list[tuple[str, int, int, float]] = []
    for part in sorted(good, key=lambda g: (-g[3], g[1], g[2])):
        if not any(part[1] < b and a < part[2] for _, a, b, _ in taken):
            taken.append(part)
    return taken


def text_spans(text: str, formats: dict, margin: float = 2.0, known: dict | None = None) -> list[tuple[str, int, int, bool, float]]:
    """Rule spans and, apart from them, parts of runs that an automaton finds likely: (kind, start, end, base, score).

    ``known`` keeps the results of class words, most of which come again.
    """
    base = rule_spans(text)
    spans = [(kind, a, b, True, 0.0) for kind, a, b, _ in base]
    if not formats["kinds"]:
        return spans
    known = {} if known is None else known
    for start, end in rests(text, base, min(LONG, *(table["shortest"] for table in formats["kinds"].values()))):
        word = text[start:end].translate(TO_CLASS)
        parts = known.get(word)
        if parts is None:
            parts = likely_parts(word, formats, margin)
            if len(word) <= 200:
                if len(known) >= 100_000:
                    known.clear()
                known[word] = parts
        spans += [(kind, start + a, start + b, False, score) for kind, a, b, score in parts]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def span_column(formats: dict):
    """Function from a text column to its spans."""
    known: dict = {}

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
        names = ("kind", "start", "end", "base", "score")
        return pa.array([[dict(zip(names, s, strict=True)) for s in text_spans(t, formats, known=known)] for t in texts.to_pylist()], pa.list_(kind))

    return spans


def scan(docs: DataFrame, formats: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``spans`` of every whole text, by start and kind; offsets count code points, ends are open.

    Null and empty texts have no spans; repeated rows are scanned alike; other columns are not read.
    """
    return docs.select(F.col(id_col), span_column(formats)(whole(F.col(text_col))).alias("spans"))


def redact(text: Column, formats: dict) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one. Null stays null."""
    known: dict = {}

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redact_text(t, text_spans(t, formats, known=known)) for t in texts.to_pylist()], pa.string())

    return clean(text)


def redact_text(text: str, spans: Iterable[tuple]) -> str:
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
