"""Boolean full-text queries: text -> syntax tree -> Column.

Operators are AND, OR, NOT (``&&``, ``||``, ``-``), parentheses, quoted phrases, ``word*`` prefixes, field scopes ``title,body:word`` and
``NEAR(a "b c", 5)``. Words side by side mean AND; NOT binds tightest, OR loosest. Parsing is a table of binding powers over a list of
lexemes; trees are built in a canonical form (flat, no double negation, several NOTs of one AND merged at the place of the first).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlit.errors import QueryError
from lumenlit.functions.text import fold_words, let

FIELDS = ("title", "abstract", "body")
MAX_DEPTH, NEAR_DISTANCE = 32, 10


@dataclass(frozen=True)
class Leaf:
    """A run of words in one field; one word may be a prefix."""

    words: tuple[str, ...]
    fields: tuple[str, ...] = FIELDS
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    """Leaves that occur close together in one field."""

    parts: tuple[Leaf, ...]
    distance: int = NEAR_DISTANCE
    fields: tuple[str, ...] = FIELDS


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Many:
    """``kind`` "and" or "or" over two or more parts."""

    kind: str
    parts: tuple


def negate(node: object) -> object:
    return node.part if isinstance(node, Not) else Not(node)


def combine(kind: str, parts: list) -> object:
    """Canonical AND or OR: nested ones of the same kind flattened, several NOTs of an AND merged into one."""
    flat = [q for p in parts for q in (p.parts if isinstance(p, Many) and p.kind == kind else (p,))]
    negative = [p for p in flat if isinstance(p, Not)]
    if kind == "and" and len(negative) > 1:
        merged = Not(combine("or", [p.part for p in negative]))
        at = flat.index(negative[0])
        flat = [p for p in flat[:at] if not isinstance(p, Not)] + [merged] + [p for p in flat[at:] if not isinstance(p, Not)]
    return flat[0] if len(flat) == 1 else Many(kind, tuple(flat))


_SCOPE = r"[A-Za-z]+(?:,[A-Za-z]+)*:"
_LEXEMES = re.compile(
    rf"""(?P<space>\s+)|(?P<and>&&|AND(?=[\s()"]|$))|(?P<or>\|\||OR(?=[\s()"]|$))|(?P<not>-|NOT(?=[\s()"]|$))|(?P<open>\()|(?P<close>\))
    |(?P<near>(?:{_SCOPE})?NEAR\((?P<inside>(?:"[^"]*"|[^")])*)(?P<shut>\))?)
    |(?P<phrase>(?:{_SCOPE})?"(?P<quoted>[^"]*)(?P<endquote>")?)
    |(?P<word>(?:(?!&&|\|\|)[^\s()"])+)""",
    re.X,
)


def _fields(scope: str, at: int) -> tuple[str, ...]:
    names = tuple(scope.rstrip(":").split(",")) if scope else FIELDS
    if len(set(names)) < len(names) or not set(names) <= set(FIELDS):
        raise QueryError(f"a scope names fields of {FIELDS}, each once", at, scope)
    return names


def _leaf(text: str, fields: tuple[str, ...], at: int, source: str) -> Leaf:
    prefix = text.endswith("*") and not source.lstrip().endswith('"')
    words = tuple(fold_words(text))
    if not words:
        raise QueryError("nothing to search for", at, source)
    return Leaf(words, fields, prefix)


def _scan(text: str, default: tuple[str, ...]) -> list[tuple[str, int, str, object]]:
    out, at = [], 0
    while at < len(text):
        m = _LEXEMES.match(text, at)
        kind, source = next((k, m[k]) for k in ("space", "and", "or", "not", "open", "close", "near", "phrase", "word") if m[k] is not None)
        if kind == "space":
            at = m.end()
            continue
        scope = re.match(_SCOPE, source) if kind in ("near", "phrase", "word") else None
        fields = _fields(scope[0], at) if scope else default
        node = None
        if kind == "word":
            if scope and scope.end() == len(source):
                raise QueryError("a field scope must be followed by a word or a phrase", at, source)
            node = _leaf(source[scope.end() if scope else 0 :], fields, at, source)
        elif kind == "phrase":
            if m["endquote"] is None:
                raise QueryError("a phrase is never closed", at, '"')
            node = _leaf(m["quoted"], fields, at, '"')
        elif kind == "near":
            if m["shut"] is None:
                raise QueryError("NEAR( is never closed", at, "(")
            inside, distance = re.fullmatch(r"(.*?)(?:,\s*([0-9]+)\s*)?", m["inside"], re.S).groups()
            if "," in re.sub(r'"[^"]*"', "", inside):
                raise QueryError("NEAR takes a whole number behind its comma", at, ",")
            parts = [_leaf(p.strip('"'), fields, at, p) for p in re.findall(r'"[^"]*"|[^\s"]+', inside)]
            if not parts:
                raise QueryError("NEAR needs at least one term", at, source)
            if len(parts) == 1 and len(parts[0].words) > 1 and '"' in inside:
                parts = [Leaf((w,), fields) for w in parts[0].words]
            node = parts[0] if len(parts) == 1 else Near(tuple(parts), int(distance) if distance else NEAR_DISTANCE, fields)
        out.append(("leaf" if node else kind, at, source, node))
        at = m.end()
    return [*out, ("end", len(text), "", None)]


def parse(text: str, default_fields: tuple[str, ...] = FIELDS) -> object:
    """Syntax tree of a query text; QueryError knows position and token of a fault."""
    lexemes = _scan(text, tuple(default_fields) or FIELDS)
    place = 0

    def expression(power: int, depth: int) -> object:
        nonlocal place
        kind, at, source, node = lexemes[place]
        place += 1
        if kind == "not":
            odd = True
            while lexemes[place][0] == "not":
                odd, place = not odd, place + 1
            left = expression(3, depth)
            left = negate(left) if odd else left
        elif kind == "open":
            if depth == MAX_DEPTH:
                raise QueryError("parentheses nest too deeply", at, "(")
            left = expression(0, depth + 1)
            if lexemes[place][0] != "close":
                raise QueryError("a parenthesis is never closed", at, "(")
            place += 1
        elif kind == "leaf":
            left = node
        else:
            raise QueryError("a word, a phrase or a group is missing" if kind != "end" or place > 1 else "the query is empty", at, source)
        while True:
            kind, at, source, _ = lexemes[place]
            own = {"or": 1, "and": 2, "leaf": 2, "open": 2, "not": 2}.get(kind, 0)
            if own <= power or not own:
                return left
            place += kind in ("or", "and")
            left = combine("or" if kind == "or" else "and", [left, expression(own, depth)])

    tree = expression(0, 0)
    if lexemes[place][0] != "end":
        raise QueryError("unexpected text", lexemes[place][1], lexemes[place][2])
    return tree


def leaves(node: object) -> list:
    """Leaves and NEAR groups, in order."""
    if isinstance(node, Not):
        return leaves(node.part)
    return [x for p in node.parts for x in leaves(p)] if isinstance(node, Many) else [node]


def rankable(node: object) -> bool:
    """Whether matches can be scored: some part of the query must say what a match holds."""
    if isinstance(node, Not):
        return False
    if isinstance(node, Many) and node.kind == "or":
        return all(map(rankable, node.parts))
    if isinstance(node, Many):
        positive = [p for p in node.parts if not isinstance(p, Not)]
        return bool(positive) and all(map(rankable, positive)) and all(rankable(p.part) for p in node.parts if isinstance(p, Not))
    return True


def parse_ranked(text: str, default_fields: tuple[str, ...] = FIELDS) -> object:
    """A tree that can be ranked; the error points at the first NOT."""
    tree = parse(text, default_fields)
    if not rankable(tree):
        at = next((x for x in _scan(text, FIELDS) if x[0] == "not"), (None, 0, "", None))
        raise QueryError("a query of only negations cannot be ranked", at[1], at[2])
    return tree


def parse_semantic(text: str, default_fields: tuple[str, ...] = FIELDS) -> object:
    """A tree with words to embed; a query of prefixes and negations only has none."""
    tree = parse(text, default_fields)
    if not semantic_text(tree):
        first = next(x for x in _scan(text, FIELDS) if x[0] != "open")
        raise QueryError("a semantic query needs a whole word that is not negated", first[1], first[2])
    return tree


def semantic_text(node: object) -> str:
    """Positive words, prefixes left out, in order: what is embedded."""
    if isinstance(node, Not):
        return ""
    if isinstance(node, (Many, Near)):
        return " ".join(x for x in map(semantic_text, node.parts) if x)
    return "" if node.prefix and len(node.words) == 1 else " ".join(node.words[: -1 if node.prefix else None])


def describe(node: object, operator: str = "", negated: bool = False, depth: int = 0) -> list[dict]:
    """Chips of a query: label, fields, operator in front, negation and depth of every leaf."""
    if isinstance(node, Not):
        return describe(node.part, operator, not negated, depth)
    if isinstance(node, Many):
        return [c for i, p in enumerate(node.parts) for c in describe(p, node.kind if i else operator, negated, depth + 1)]
    inner = node.parts if isinstance(node, Near) else (node,)
    label = " ".join(" ".join(x.words) + "*" * x.prefix for x in inner)
    return [{"label": label, "fields": list(node.fields), "operator": operator, "negated": negated, "depth": depth}]


class View:
    """How a leaf's occurrences in a document are read: ``starts`` gives its 0-based places in a field, ``count`` how many there are."""

    def starts(self, leaf: Leaf, field: str) -> Column:
        raise NotImplementedError

    def count(self, leaf: Leaf, field: str) -> Column:
        return F.size(self.starts(leaf, field))

    def holds(self, leaf: Leaf, field: str) -> Column:
        return self.count(leaf, field) > 0


class TokenView(View):
    """Documents with token arrays ``tok_<field>``."""

    def starts(self, leaf: Leaf, field: str) -> Column:
        k = len(leaf.words)
        *whole, last = leaf.words

        def places(t: Column) -> Column:
            def here(i: Column) -> Column:
                tests = [F.get(t, i + j) == w for j, w in enumerate(whole)]
                end = F.get(t, i + (k - 1))
                return reduce(Column.__and__, [*tests, end.startswith(last) if leaf.prefix else end == last])

            span = F.when(F.size(t) >= k, F.sequence(F.lit(0), F.greatest(F.size(t) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            return F.filter(span, here)

        return let(F.col(f"tok_{field}"), places)

    def count(self, leaf: Leaf, field: str) -> Column:
        if len(leaf.words) > 1:
            return F.size(self.starts(leaf, field))
        w = leaf.words[0]
        return F.size(F.filter(F.col(f"tok_{field}"), (lambda x: x.startswith(w)) if leaf.prefix else (lambda x: x == w)))

    def holds(self, leaf: Leaf, field: str) -> Column:
        if len(leaf.words) == 1 and not leaf.prefix:
            return F.array_contains(F.col(f"tok_{field}"), leaf.words[0])
        return self.count(leaf, field) > 0


TOKENS = TokenView()


def _near(node: Near, field: str, view: View) -> Column:
    """Some start p has, for every part, a start no more than ``distance`` words and the part's own length in front of it."""
    lengths = [len(p.words) for p in node.parts]
    within = lambda p, k: lambda q: (q <= p) & (q >= p - k - node.distance)

    def close(all_starts: Column) -> Column:
        each = [(F.get(all_starts, F.lit(i)), k) for i, k in enumerate(lengths)]
        return F.exists(F.flatten(all_starts), lambda p: reduce(Column.__and__, [F.exists(s, within(p, k)) for s, k in each]))

    return let(F.array(*[view.starts(p, field) for p in node.parts]), close)


def matches(node: object, view: View = TOKENS) -> Column:
    """Whether a document matches the query."""
    if isinstance(node, Not):
        return ~matches(node.part, view)
    if isinstance(node, Many):
        return reduce(Column.__and__ if node.kind == "and" else Column.__or__, [matches(p, view) for p in node.parts])
    if isinstance(node, Near):
        return reduce(Column.__or__, [_near(node, f, view) for f in node.fields])
    return reduce(Column.__or__, [view.holds(node, f) for f in node.fields])


def matches_nothing(node: object) -> bool:
    """Whether a document without any word of the query matches it."""
    if isinstance(node, Not):
        return not matches_nothing(node.part)
    if isinstance(node, Many):
        return (all if node.kind == "and" else any)(map(matches_nothing, node.parts))
    return False
