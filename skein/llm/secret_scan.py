"""Secret scans by grammar inference.

Labelled credentials (what the three base patterns match, labelled by kind) are read as strings of character classes.
For each kind the prefix tree of all of them, counted by Spark, is folded into a probabilistic automaton by merging states
whose outgoing frequencies are statistically compatible (Hoeffding bound, red and blue states). A prefix that fewer than
one in `SHARE` of a kind's credentials have is no state: as the bound accepts almost anything there, what follows it is
counted from the start state on. Frequencies and thresholds are then those of all labelled credentials, walked through
the automaton. Every candidate run in every text is then scored by its log-likelihood a character under
the automata; a run as likely as the labelled ones is a span of kind `format`, unless it overlaps a base span.

Scale: different credentials are shuffled once, their prefixes as hashes with map-side combine; the driver gets at most
`SHARE` prefixes of each length, the frequencies of an automaton's states, and a histogram of scores.

Defined results: a null text counts as empty; repeated rows give repeated results; with no labelled credential there
is no automaton and only base spans are reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of, written

KINDS = ("assign", "access", "hex")
SHARE = 400  # a prefix is a state if one in so many labelled credentials of its kind has it
STEPS = 10_000  # of a score: thresholds are rounded down to one of them
HELD = 1 << 18  # prefixes that a task adds up at once
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ are maximal, so the short ones can go at once
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Character classes and how many characters each holds.
CLASSES = {"0": 10, "h": 6, "l": 20, "H": 6, "U": 20}
SYMBOL = {c: k for k, cs in (("0", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ")) for c in cs}
TRANSLATE = str.maketrans(SYMBOL)
END = "$"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base patterns' matches, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Automaton:
    """A probabilistic automaton over character classes, merged from the prefix tree of labelled strings."""

    def __init__(self, tree: list[tuple[int, str, int, int]], alpha: float = 0.05):
        """tree: (prefix, next symbol, prefix with it, how many strings), of the prefixes that are states; 0: the empty one."""
        place = {0: 0}
        for prefix, *_ in tree:
            place.setdefault(prefix, len(place))
        self.next: list[dict[str, int]] = [{} for _ in place]
        self.count: list[dict[str, int]] = [defaultdict(int) for _ in place]
        for prefix, c, longer, n in tree:
            self.count[place[prefix]][c] += n
            if c != END and longer in place:
                self.next[place[prefix]][c] = place[longer]
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def learned(self, counts: list[tuple[int, str, int]]) -> Automaton:
        """Takes (state, symbol, how often) of all strings that it learns from."""
        self.count = [defaultdict(int) for _ in self.next]
        for s, c, n in counts:
            self.count[s][c] += n
        self.logs = {}
        for s in self._reached():
            total = sum(self.count[s].values()) + len(CLASSES) + 1
            self.logs[s] = ({c: math.log((n + 1) / total / CLASSES.get(c, 1)) for c, n in self.count[s].items()}, math.log(1 / total / 20))
        return self

    def walk(self, word: str) -> list[tuple[int, str]]:
        """The states that a word passes, each with the symbol that follows."""
        at, out = 0, []
        for c in word:
            out.append((at, c))
            at = self.next[at].get(c, 0)
        return [*out, (at, END)]

    def _reached(self) -> list[int]:
        seen, todo = {0}, [0]
        while todo:
            for t in self.next[todo.pop()].values():
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return sorted(seen)

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states' outgoing frequencies differ by no more than chance, and so on below."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.count[a], self.count[b]
            n, m = sum(x.values()), sum(y.values())
            if not n or not m:
                continue
            bound = self.width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > bound for c in {*x, *y}):
                return False
            if bound < 2:  # a wider bound accepts anything, there and below
                todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a] if c in self.next[b]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        red, known = [0], {0}
        while True:
            blue = next(((s, c, t) for s in red for c, t in sorted(self.next[s].items()) if t not in known), None)
            if blue is None:
                return
            s, c, t = blue
            for r in red:
                if self._alike(r, t):
                    self.next[s][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
                known.add(t)

    def score(self, word: str) -> float:
        """Mean log-likelihood a character, with the end."""
        at, total = 0, 0.0
        for c in word:
            known, rest = self.logs[at]
            total += known.get(c, rest)
            at = self.next[at].get(c, 0)
        known, rest = self.logs[at]
        return (total + known.get(END, rest)) / (len(word) + 1)


def labelled(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, shape, n): the character classes of what the base patterns matched, and of how many different values."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            found = set()
            for text in batch.column(0).to_pylist():
                for a, kind, b in base_spans(text):
                    found.add((KINDS[kind], ASSIGN.match(text, a)[2] if kind == 0 else text[a:b]))
            return {"kind": [k for k, _ in found], "value": [v for _, v in found]}

        return f

    found = map_rows(df.select(text_of(text_col).alias("t")), "kind string, value string", make).dropDuplicates()
    return found.groupBy("kind", F.translate("value", "".join(SYMBOL), "".join(SYMBOL.values())).alias("shape")).agg(F.count("*").alias("n"))


def summed(shapes: DataFrame, keys: str, keys_of: Callable[[str, str], Iterable[tuple]]) -> DataFrame:
    """(kind, the keys, n): how many values have the keys that keys_of(kind, shape) lists; tasks add up as much as they can hold."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"kind string, {keys}, n long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        found: dict[tuple, int] = defaultdict(int)
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*[(*k, n) for k, n in found.items()]), arrow)], schema=arrow)
        for batch in batches:
            for kind, shape, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key in keys_of(kind, shape):
                    found[(kind, *key)] += n
                if len(found) > HELD:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    names = [f.name for f in arrow][:-1]
    return shapes.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def prefixes(_: str, shape: str) -> Iterable[tuple[int, str, int]]:
    """(prefix, next symbol, prefix with it), prefixes as hashes, the empty one as 0."""
    at = 0
    for c in shape + END:
        longer = xxhash.xxh3_64_intdigest(f"{at}{c}") - (1 << 63)
        yield at, c, longer
        at = longer


def learn(df: DataFrame, text_col: str = "text") -> dict[str, tuple[Automaton, float]]:
    """An automaton for each kind and the score that 95 in 100 of its labelled credentials reach."""
    shapes = written(labelled(df, text_col), "credentials")
    tree = written(summed(shapes, "prefix long, symbol string, longer long", prefixes), "prefixes")
    total = tree.filter("prefix = 0").groupBy("kind").agg(F.sum("n").alias("total"))
    states = tree.filter(F.col("symbol") != END).join(F.broadcast(total), "kind").filter(F.col("n") * SHARE >= F.col("total")).select("kind", F.col("longer").alias("prefix"))
    rows = defaultdict(list)
    for r in tree.filter("prefix = 0").union(tree.join(F.broadcast(states), ["kind", "prefix"], "left_semi").select(*tree.columns)).collect():  # SHARE prefixes of each length at most
        rows[r.kind].append((r.prefix, r.symbol, r.longer, r.n))
    models = {kind: Automaton(sorted(x)) for kind, x in sorted(rows.items())}
    counts = defaultdict(list)
    for r in summed(shapes, "state int, symbol string", lambda kind, shape: models[kind].walk(shape)).collect():  # a number for each arc
        counts[r.kind].append((r.state, r.symbol, r.n))
    models = {kind: model.learned(counts[kind]) for kind, model in models.items()}
    scores = defaultdict(list)
    for r in summed(shapes, "step int", lambda kind, shape: [(math.floor(models[kind].score(shape) * STEPS),)]).collect():  # a number for each step
        scores[r.kind].append((r.step, r.n))
    return {kind: (model, at_share(scores[kind], 20) / STEPS) for kind, model in models.items()}


def at_share(found: list[tuple[int, int]], share: int) -> int:
    """The least value (of values with their numbers) that all but one in `share` reach."""
    left = sum(n for _, n in found) // share
    for x, n in sorted(found):
        left -= n
        if left < 0:
            return x
    return 0


def format_spans(text: str, models: dict, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidate runs with letters and digits that some automaton finds as likely as its labelled credentials."""
    out = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        shape = word.translate(TRANSLATE)
        if "0" not in shape or not any(c in shape for c in "hlHU"):
            continue
        a, b = m.span()
        if any(x < b and a < y for x, _, y in base):
            continue
        if any(model.score(shape) >= least for model, least in models.values()):
            out.append((a, 3, b))
    return out


def scan_secrets(df: DataFrame, models: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for each row; spans are kind:start:end in code points."""
    kind = df.schema[id_col].dataType.simpleString()
    names = (*KINDS, "format")

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            out = {id_col: batch.column(0), "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(x[1] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["spans"].append(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(base + format_spans(text, models, base))))
            return out

        return f

    return map_rows(df.select(F.col(id_col), text_of(text_col).alias("t")), f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)
