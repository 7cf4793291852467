"""Texts of a page: clusters, the lines and contents in them, and the things that they name.

texts: keys, id, text, x0, y0, x1, y1, font_size, dx, dy (direction), block_index, line_index, span_index (null where not known);
targets: keys, id, type, x0, y0, x1, y1 and, for symbols, symbol_id. Ids are unique within the keys. A page is matched in one task.

Stages, each with what the ones before left: endpoints, wire marks, symbols by their markers, arrows, containers, symbols by their boxes.
Defined cases: null font sizes are 0, null directions (1, 0); a text without a target stays; ties go by distance, area, then id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import boxes as B
from ..functions import text as X
from ..kernels.sets import Sets, cheapest_matching

KEYS = ("page",)
Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Rules:
    """Thresholds of the stages."""

    near: float = config.TEXT_NEAR
    arrow_near: float = config.ARROW_NEAR
    endpoint_near: float = config.ENDPOINT_NEAR
    mark_near: float = config.WIRE_MARK_NEAR
    symbol_near: float = config.SYMBOL_NEAR
    endpoint_chars: int = config.ENDPOINT_CHARS
    endpoint_tokens: int = config.ENDPOINT_TOKENS
    margin: float = config.AMBIGUITY
    diagonal: float = config.DIAGONAL_FACTOR
    cluster: float = config.CLUSTER_DISTANCE
    merge: float = config.MERGE_DISTANCE
    align: float = config.ALIGNMENT
    font: float = config.FONT

    def __post_init__(self) -> None:
        if any(v < 0 for v in vars(self).values()):
            raise ValueError("thresholds must not be negative")


@dataclass(frozen=True)
class Span:
    id: int
    text: str
    box: Box
    font: float
    direction: tuple[float, float]
    place: tuple[int | None, int | None, int | None]

    @property
    def vertical(self) -> bool:
        return abs(self.direction[1]) > abs(self.direction[0])


@dataclass
class Content:
    """Spans of one font that read as one."""

    spans: list[Span]
    title: bool = False
    text: str = field(init=False)
    font: float = field(init=False)

    def __post_init__(self) -> None:
        self.text, self.font = " ".join(s.text for s in self.spans), max(s.font for s in self.spans)


def _gap(a: Box, b: Box) -> float:
    return math.hypot(max(a[0] - b[2], b[0] - a[2], 0.0), max(a[1] - b[3], b[1] - a[3], 0.0))


def _edges(a: Box, b: Box, diagonal: float) -> float:
    sides = []
    for k in (0, 1):
        if min(a[3 - k], b[3 - k]) >= max(a[1 - k], b[1 - k]):
            sides += [abs(p - q) for p in (a[k], a[k + 2]) for q in (b[k], b[k + 2])]
    return min(sides) if sides else _gap(a, b) * diagonal


def _area(b: Box) -> float:
    return max(b[2] - b[0], 0.0) * max(b[3] - b[1], 0.0)


def _around(spans: Sequence[Span]) -> Box:
    return (min(s.box[0] for s in spans), min(s.box[1] for s in spans), max(s.box[2] for s in spans), max(s.box[3] for s in spans))


def related(a: Span, b: Span, distance: float, rules: Rules) -> bool:
    """Both level or both upright, with starts, ends or middles in line one way or the other, and that close."""
    if a.vertical != b.vertical or _gap(a.box, b.box) > distance:
        return False
    in_line = lambda k: any(abs(p - q) <= rules.align for p, q in zip((a.box[k], a.box[k + 2], (a.box[k] + a.box[k + 2]) / 2), (b.box[k], b.box[k + 2], (b.box[k] + b.box[k + 2]) / 2), strict=True))
    return in_line(0) or in_line(1)


def before(a: Span, b: Span) -> int:
    """Reading order: by span within one line, else down the page and along the line, or along and down for upright texts; then by id."""
    if a.place[0] is not None and a.place[1] is not None and a.place[:2] == b.place[:2]:
        m, n = (s.place[2] if s.place[2] is not None else s.id for s in (a, b))
        if m != n:
            return -1 if m < n else 1
    upright = a.vertical and b.vertical
    first, second = (0, 1) if upright else (1, 0)
    key = lambda s: (s.box[first], s.box[second] if s.direction[second] >= 0 else -s.box[second], s.id)
    return (key(a) > key(b)) - (key(a) < key(b))


def in_order(spans: Sequence[Span]) -> list[Span]:
    return sorted(sorted(spans, key=lambda s: s.id), key=cmp_to_key(before))


def _joined(spans: Sequence[Span], together: Callable[[Span, Span], bool]) -> list[list[Span]]:
    spans = sorted(spans, key=lambda s: s.id)
    sets = Sets(len(spans))
    order = sorted(range(len(spans)), key=lambda i: spans[i].box[0])
    for n, i in enumerate(order):
        reach = spans[i].box[2] + max(config.CLUSTER_DISTANCE, config.MERGE_DISTANCE, config.FONT_REACH * max((s.font for s in spans), default=0.0))
        for j in order[n + 1 :]:
            if spans[j].box[0] > reach:
                break
            if together(spans[min(i, j)], spans[max(i, j)]):
                sets.join(i, j)
    out = [in_order([spans[i] for i in g]) for g in sets.groups()]
    return sorted(out, key=lambda g: (g[0].box[1], g[0].box[0], g[0].id))


def clusters_of(spans: Sequence[Span], rules: Rules) -> list[list[Span]]:
    return _joined(spans, lambda a, b: related(a, b, rules.cluster, rules))


def contents_of(cluster: Sequence[Span], rules: Rules) -> list[Content]:
    """Spans of a cluster of one font that are close for their size, as contents."""

    def together(a: Span, b: Span) -> bool:
        return math.isclose(a.font, b.font, rel_tol=0.0, abs_tol=rules.font) and related(a, b, max(rules.merge, config.FONT_REACH * max(a.font, b.font)), rules)

    return [Content(g) for g in _joined(cluster, together)]


def mark_titles(contents: list[Content], rules: Rules, forced: int | None = None) -> None:
    """Contents of the largest font are titles if there are smaller ones; or the forced one alone."""
    largest = max(c.font for c in contents)
    big = [math.isclose(c.font, largest, rel_tol=0.0, abs_tol=rules.font) for c in contents]
    for k, c in enumerate(contents):
        c.title = k == forced if forced is not None else big[k] and not all(big)


def context_of(cluster: Sequence[Span], contents: Sequence[Content]) -> str:
    named = {s.id for c in contents if c.title for s in c.spans}
    title = " ".join(c.text for c in contents if c.title).strip()
    rest = " ".join(s.text for s in cluster if s.id not in named).strip()
    return f"{title}: {rest}" if title and rest else title or rest


@dataclass
class Target:
    id: int
    type: str
    box: Box
    markers: frozenset[str] = frozenset()


def nearest_sure(box: Box, targets: Sequence[Target], reach: float, rules: Rules) -> tuple[Target, float] | None:
    """The nearest target within reach, unless another is nearly as near."""
    ranked = sorted((_edges(box, t.box, rules.diagonal), _area(t.box), t.id, k) for k, t in enumerate(targets))
    if not ranked or ranked[0][0] > reach or len(ranked) > 1 and ranked[1][0] <= reach and ranked[1][0] - ranked[0][0] < rules.margin:
        return None
    return targets[ranked[0][3]], ranked[0][0]


def _holding(span: Span, targets: Sequence[Target]) -> Target | None:
    b = span.box
    inside = [t for t in targets if t.box[0] <= b[0] and t.box[1] <= b[1] and t.box[2] >= b[2] and t.box[3] >= b[3]]
    centre = lambda t: math.hypot((b[0] + b[2] - t.box[0] - t.box[2]) / 2, (b[1] + b[3] - t.box[1] - t.box[3]) / 2)
    return min(inside, key=lambda t: (_area(t.box), centre(t), t.id), default=None)


def vote(cluster: Sequence[Span], contents: Sequence[Content], given: dict[int, tuple[Target, float]]) -> Target | None:
    """The target of most spans: of titles where fonts differ and some title has one, else of all; ties by summed distance, area, id."""
    titles = [s for c in contents if c.title for s in c.spans if s.id in given]
    voters = titles or [s for s in cluster if s.id in given]
    counts, far = Counter(), defaultdict(float)
    for s in voters:
        t, d = given[s.id]
        counts[t.id] += 1
        far[t.id] += d
    by = {given[s.id][0].id: given[s.id][0] for s in voters}
    return by[min(counts, key=lambda i: (-counts[i], far[i], _area(by[i].box), i))] if counts else None


_TOKEN = re.compile(r"[+\-=]?[A-Za-z][A-Za-z0-9_.-]*")
_DIGITS = re.compile(r"[0-9_.-]+")


def marker_quality(text: str, markers: frozenset[str]) -> int | None:
    """0 if a token of the text is a marker, 1 if one with digits after it."""
    found = [t.lstrip("+-=").upper() for t in _TOKEN.findall(text)]
    if any(t in markers for t in found):
        return 0
    return 1 if any(t.startswith(m) and _DIGITS.fullmatch(t[len(m) :]) for t in found for m in markers) else None


class Matching:
    """One page's texts, matched stage by stage."""

    def __init__(self, spans: Sequence[Span], targets: Sequence[Target], endpoints: Sequence[Target], catalog: bool, rules: Rules):
        self.rules, self.matches, self.told = rules, [], []
        of = lambda *kinds: [t for t in targets if t.type in kinds]
        every = clusters_of(spans, rules)
        left = self.to_endpoints(every, endpoints)
        left = self.by_vote(left, of("wire_mark"), rules.mark_near, False)
        symbols = of("symbol")
        left = self.to_symbols(left, symbols) if catalog else self.by_vote(left, symbols, rules.near, False)
        left = self.by_vote(left, of("arrow"), rules.arrow_near, False)
        left = self.by_vote(left, of("box", "dashed"), rules.near, True)
        self.into_symbols(left, symbols)
        done = {i for m in self.matches for i in m[3]}
        self.rest = []
        for cluster in every:
            spare = [s for s in cluster if s.id not in done]
            if spare:
                contents = contents_of(spare, rules)
                mark_titles(contents, rules)
                self.rest.append((context_of(spare, contents), [c.text for c in contents if c.title], [s.id for s in spare], _around(spare)))

    def _store(self, kind: str, target: Target, cluster: Sequence[Span], contents: list[Content], forced: int | None = None, plain: bool = False) -> None:
        mark_titles(contents, self.rules, forced)
        if plain:
            for c in contents:
                c.title = False
        for c in contents:
            self.matches.append((kind, target.id, c.text, [s.id for s in c.spans], "title" if c.title else "description"))
        self.told.append((kind, target.id, [c.text for c in contents if c.title], context_of(cluster, contents)))

    def to_endpoints(self, clusters: list[list[Span]], endpoints: Sequence[Target]) -> list[list[Span]]:
        """Short clusters, each to its nearest endpoint if that is sure; the closest first, an endpoint takes one."""
        wanted = []
        for n, cluster in enumerate(clusters):
            contents = contents_of(cluster, self.rules)
            words = [" ".join(c.text.split()) for c in contents]
            if all(w and len(w) <= self.rules.endpoint_chars and len(w.split()) <= self.rules.endpoint_tokens for w in words):
                near = nearest_sure(_around(cluster), endpoints, self.rules.endpoint_near, self.rules)
                if near:
                    wanted.append((near[1], n, near[0].id, near[0], contents))
        used, taken = set(), set()
        for _, n, i, target, contents in sorted(wanted, key=lambda w: w[:3]):
            if i not in taken:
                taken.add(i)
                used.add(n)
                self._store("endpoint", target, clusters[n], contents)
        return [c for n, c in enumerate(clusters) if n not in used]

    def to_symbols(self, clusters: list[list[Span]], symbols: Sequence[Target]) -> list[list[Span]]:
        """As many symbols as can be to clusters that name their markers within reach; then with the best markers, then the least distance."""
        contents = [contents_of(c, self.rules) for c in clusters]
        pairs, group = [], {}
        for r, s in enumerate(symbols):
            for n, cluster in enumerate(clusters):
                named = [(q, k) for k, c in enumerate(contents[n]) if s.markers and (q := marker_quality(c.text, s.markers)) is not None]
                d = _edges(_around(cluster), s.box, self.rules.diagonal)
                if named and d <= self.rules.symbol_near:
                    pairs.append((r, n, (float(min(named)[0]), d)))
                    group[r, n] = min(named)[1]
        chosen = cheapest_matching(pairs, len(symbols), len(clusters))
        for r, n in sorted(chosen, key=lambda p: (p[1], p[0])):
            self._store("component", symbols[r], clusters[n], contents[n], forced=group[r, n])
        used = {n for _, n in chosen}
        return [c for n, c in enumerate(clusters) if n not in used]

    def by_vote(self, clusters: list[list[Span]], targets: Sequence[Target], reach: float, containers: bool) -> list[list[Span]]:
        """Clusters to the target that their spans vote for: each for its sure nearest, or, for containers, the smallest that holds it."""
        left = []
        for cluster in clusters:
            given: dict[int, tuple[Target, float]] = {}
            for s in cluster:
                near = nearest_sure(s.box, targets, reach, self.rules)
                held = None if near or not containers else _holding(s, targets)
                if near or held:
                    given[s.id] = near or (held, 0.0)
            contents = contents_of(cluster, self.rules)
            mark_titles(contents, self.rules)
            target = vote(cluster, contents, given)
            if target is None:
                left.append(cluster)
            else:
                self._store("component", target, cluster, contents)
        return left

    def into_symbols(self, clusters: list[list[Span]], symbols: Sequence[Target]) -> None:
        """What lies within a symbol's box describes it."""
        held: dict[int, list[Span]] = defaultdict(list)
        by = {t.id: t for t in symbols}
        for s in (s for c in clusters for s in c):
            t = _holding(s, symbols)
            if t:
                held[t.id].append(s)
        for i, spans in held.items():
            for cluster in clusters_of(spans, self.rules):
                self._store("component", by[i], cluster, contents_of(cluster, self.rules), plain=True)


MATCH = "what string, target_kind string, target bigint, text string, text_ids array<bigint>, role string, titles array<string>, x0 double, y0 double, x1 double, y1 double"


def _spans(table: pa.Table) -> list[Span]:
    columns = ("id", "text", *B.CORNERS, "font_size", "dx", "dy", "block_index", "line_index", "span_index")
    rows = zip(*(table[c].to_pylist() for c in columns), strict=True)
    return [Span(r[0], (r[1] or "").strip(), r[2:6], r[6] or 0.0, (1.0 if r[7] is None else r[7], r[8] or 0.0), r[9:12]) for r in rows if None not in r[2:6]]


def match_texts(texts: DataFrame, targets: DataFrame, endpoints: DataFrame, records: DataFrame | None = None, *, keys: Sequence[str] = KEYS, rules: Rules = Rules()) -> DataFrame:
    """(keys, MATCH): rows of what match (a content of a target, as title or description), told (a target's titles and the cluster as a whole) and rest
    (clusters that are left, with their box).

    records (symbol_id, type) name symbols' markers; without them symbols are matched by distance alone.
    """
    marks = None if records is None else records.groupBy(F.col("symbol").alias("symbol_id")).agg(F.array_distinct(F.flatten(F.collect_list(X.markers(F.col("type"))))).alias("markers"))
    things = targets.select(*keys, "id", "type", *B.CORNERS, "symbol_id")
    things = things.join(F.broadcast(marks), "symbol_id", "left") if marks is not None else things.withColumn("markers", F.lit(None).cast("array<string>"))
    both = things.select(*keys, F.struct(F.lit("component").alias("kind"), "id", "type", *B.CORNERS, "markers").alias("t")).unionByName(endpoints.select(*keys, F.struct(F.lit("endpoint").alias("kind"), "id", F.lit("endpoint").alias("type"), *B.CORNERS, F.lit(None).cast("array<string>").alias("markers")).alias("t")))
    schema = T.StructType([*(texts.schema[k] for k in keys), *T.StructType.fromDDL(MATCH).fields])
    catalog = records is not None

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        things = [(r["kind"], Target(r["id"], r["type"], tuple(r[c] for c in B.CORNERS), frozenset(r["markers"] or ()))) for r in right["t"].to_pylist()]
        found = Matching(_spans(left), sorted((t for k, t in things if k == "component"), key=lambda t: t.id), sorted((t for k, t in things if k == "endpoint"), key=lambda t: t.id), catalog, rules)
        rows = [("match", k, i, text, ids, role, None, None, None, None, None) for k, i, text, ids, role in found.matches]
        rows += [("told", k, i, text, None, None, titles, None, None, None, None) for k, i, titles, text in found.told]
        rows += [("rest", None, None, text, ids, None, titles, *box) for text, titles, ids, box in found.rest]
        heads = [pa.array([k.as_py()] * len(rows), left.schema.field(n).type) for k, n in zip(key, keys, strict=True)]
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields[len(keys) :]]
        return pa.table([*heads, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=[f.name for f in schema.fields])

    return texts.groupBy(*keys).cogroup(both.groupBy(*keys)).applyInArrow(run, schema)


def text_clusters(texts: DataFrame, *, keys: Sequence[str] = KEYS, rules: Rules = Rules()) -> DataFrame:
    """(keys, cluster, content, place, id, title): texts in reading order within contents within clusters, and whether the content is a title."""
    schema = T.StructType([*(texts.schema[k] for k in keys), *T.StructType.fromDDL("cluster int, content int, place int, id bigint, title boolean").fields])

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for n, cluster in enumerate(clusters_of(_spans(table), rules)):
            contents = contents_of(cluster, rules)
            mark_titles(contents, rules)
            rows += [(n, k, place, s.id, c.title) for k, c in enumerate(contents) for place, s in enumerate(c.spans)]
        heads = [pa.array([table[k][0].as_py()] * len(rows), table.schema.field(k).type) for k in keys]
        return pa.table([*heads, *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()))]], names=[f.name for f in schema.fields])

    return texts.groupBy(*keys).applyInArrow(run, schema)


def semantic_matches(matches: DataFrame) -> DataFrame:
    """Rows of matches with semantic_role, what their text means."""
    return matches.where("what = 'match'").withColumn("semantic_role", X.semantic_role(F.col("text")))


def text_owners(matches: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, text, target_kind, target): who owns each text."""
    return matches.where("what = 'match'").select(*keys, F.explode("text_ids").alias("text"), "target_kind", "target")
