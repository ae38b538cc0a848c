"""Row filters [F8]: a small expression language over op, schema, table, new and old, compiled to a Column.

Values of new and old are text; against a number or boolean literal they are read as one. Selecting a
column that a row doesn't have is an error of that row, unless the other side of && or || decides.
A boolean that can't be evaluated is null, so SQL's three-valued AND and OR absorb errors as the language asks,
with one copy of each side. Expressions that are malformed, use unknown names or aren't boolean are errors when compiled.

Known: literals, lists, op, schema, table, new, old, selection and indexing by text, has(), size(), startsWith(),
endsWith(), contains(), matches(), in, comparisons, !, &&, ||, ?:, and + - * / % on numbers and + on text. Refused when
compiled: macros over lists (all, exists, map, filter), time values, type conversions, bytes and maps as literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    pass


@dataclass
class Node:
    """kind: bool, string, number, null, dyn (text of a row), map or list.

    err: whether this row can't be evaluated, None if every row can. A bool has none: it is null where it can't.
    """

    kind: str
    value: Column | None
    err: Column | None = None
    items: tuple[Node, ...] = ()


def _any(*errs: Column | None) -> Column | None:
    some = [e for e in errs if e is not None]
    return reduce(lambda a, b: a | b, some) if some else None


def _bool(value: Column, *errs: Column | None) -> Node:
    err = _any(*errs)
    return Node("bool", value if err is None else F.when(~err, value))


_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?u?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[<>!?:().,\[\]+\-*/%]))"""
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "`": "`"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected {text[at:].strip()[:10]!r} in {text!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _tokens(text), 0

    def peek(self) -> str:
        kind, value = self.tokens[self.at]
        return value if kind == "op" or value == "in" else ""

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, op: str) -> bool:
        if self.peek() == op:
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise FilterError(f"expected {op!r} in {self.text!r}")

    # -- grammar -----------------------------------------------------------------------------------
    def whole(self) -> Node:
        out = self.choice()
        if self.tokens[self.at][0] != "end":
            raise FilterError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return out

    def choice(self) -> Node:
        cond = self.either()
        if not self.take("?"):
            return cond
        self.boolean(cond)
        a = self.choice()
        self.need(":")
        b = self.choice()
        if a.kind != b.kind and "dyn" in (a.kind, b.kind):
            a, b = self.alike(a, b)
        if a.kind != b.kind:
            raise FilterError(f"both branches of ?: must be of one kind in {self.text!r}")
        value = F.when(cond.value, a.value).when(~cond.value, b.value)
        if a.kind == "bool":
            return Node("bool", value)
        no = F.lit(False)
        err = F.when(cond.value, no if a.err is None else a.err).when(~cond.value, no if b.err is None else b.err).otherwise(F.lit(True))
        return Node(a.kind, value, err)

    def boolean(self, n: Node) -> None:
        if n.kind != "bool":
            raise FilterError(f"a boolean is needed, not a {n.kind}, in {self.text!r}")

    def either(self) -> Node:
        out = self.both()
        while self.take("||"):
            out = self.join(out, self.both(), True)
        return out

    def both(self) -> Node:
        out = self.relation()
        while self.take("&&"):
            out = self.join(out, self.relation(), False)
        return out

    def join(self, a: Node, b: Node, decides: bool) -> Node:
        """&& and ||: a side that decides absorbs an error of the other, in either order."""
        for n in (a, b):
            self.boolean(n)
        return Node("bool", a.value | b.value if decides else a.value & b.value)

    def relation(self) -> Node:
        left = self.sum()
        while True:
            op = self.peek()
            if op in ("==", "!="):
                self.at += 1
                right = self.sum()
                same = self.equal(left, right)
                left = _bool(same if op == "==" else ~same, left.err, right.err, *(n.value.isNull() for n in (left, right) if n.kind == "bool"))
            elif op in ("<", "<=", ">", ">="):
                self.at += 1
                left = self.ordered(op, left, self.sum())
            elif op == "in":
                self.at += 1
                left = self.member(left, self.sum())
            else:
                return left

    def sum(self) -> Node:
        left = self.product()
        while (op := self.peek()) in ("+", "-"):
            self.at += 1
            left = self.arithmetic(op, left, self.product())
        return left

    def product(self) -> Node:
        left = self.unary()
        while (op := self.peek()) in ("*", "/", "%"):
            self.at += 1
            left = self.arithmetic(op, left, self.unary())
        return left

    def arithmetic(self, op: str, a: Node, b: Node) -> Node:
        """Of numbers, where overflow and division by zero are errors of the row; + joins texts too."""
        if a.kind == b.kind == "dyn":
            raise FilterError(f"{op} of two columns has no type in {self.text!r}")
        a, b = self.alike(a, b) if "dyn" in (a.kind, b.kind) else (a, b)
        if op == "+" and a.kind == b.kind == "string":
            made = F.concat(a.value, b.value)
            return Node("string", made, _any(a.err, b.err, made.isNull()))
        if not a.kind == b.kind == "number":
            raise FilterError(f"{op} needs two numbers, not {a.kind} and {b.kind}, in {self.text!r}")
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "%": F.try_mod}[op](a.value, b.value)
        return Node("number", made, _any(a.err, b.err, made.isNull()))

    def equal(self, a: Node, b: Node) -> Column:
        """Equality of two values, never null: null equals null only."""
        if a.kind == "null" or b.kind == "null":
            other = b if a.kind == "null" else a
            return F.lit(True) if other.kind == "null" else other.value.isNull()
        if "dyn" in (a.kind, b.kind):
            a, b = self.alike(a, b)
        elif a.kind != b.kind:
            raise FilterError(f"can't compare {a.kind} with {b.kind} in {self.text!r}")
        return F.coalesce(a.value.eqNullSafe(b.value), F.lit(False))

    def alike(self, a: Node, b: Node) -> tuple[Node, Node]:
        kind = {a.kind, b.kind} - {"dyn"}
        to = next(iter(kind), "string")
        if to not in ("string", "number", "bool"):
            raise FilterError(f"can't compare with a {to} in {self.text!r}")

        def read(n: Node) -> Node:
            if n.kind != "dyn":
                return n
            if to == "number":
                return Node(to, n.value.try_cast("double"), n.err)
            if to == "bool":
                return Node(to, F.when(n.value.isin("t", "true"), F.lit(True)).when(n.value.isin("f", "false"), F.lit(False)), n.err)
            return Node(to, n.value, n.err)

        return read(a), read(b)

    def ordered(self, op: str, a: Node, b: Node) -> Node:
        a, b = self.alike(a, b)
        if a.kind != b.kind or a.kind not in ("string", "number"):
            raise FilterError(f"can't order {a.kind} and {b.kind} in {self.text!r}")
        made = {"<": a.value < b.value, "<=": a.value <= b.value, ">": a.value > b.value, ">=": a.value >= b.value}[op]
        return _bool(made, a.err, b.err)  # null and unreadable values have no order

    def member(self, item: Node, of: Node) -> Node:
        if of.kind == "map":
            if item.kind not in ("string", "dyn"):
                raise FilterError(f"column names are text in {self.text!r}")
            return _bool(F.coalesce(F.map_contains_key(of.value, item.value), F.lit(False)), item.err)
        if of.kind == "list":
            value = reduce(lambda a, b: a | b, (self.equal(item, x) for x in of.items), F.lit(False))
            return _bool(value, item.err, *(x.err for x in of.items))
        raise FilterError(f"'in' needs a row or a list in {self.text!r}")

    def unary(self) -> Node:
        if self.take("!"):
            n = self.unary()
            self.boolean(n)
            return Node("bool", ~n.value)
        if self.take("-"):
            n = self.unary()
            if n.kind != "number":
                raise FilterError(f"- needs a number in {self.text!r}")
            return Node("number", -n.value, n.err)
        return self.postfix(self.primary())

    def postfix(self, n: Node) -> Node:
        while True:
            if self.take("."):
                kind, name = self.next()
                if kind != "name":
                    raise FilterError(f"a name must follow . in {self.text!r}")
                n = self.call(name, n) if self.peek() == "(" else self.select(n, name)
            elif self.take("["):
                key = self.choice()
                self.need("]")
                if key.kind != "string" or n.kind != "map":
                    raise FilterError(f"only columns of a row can be indexed in {self.text!r}")
                n = Node("dyn", F.element_at(n.value, key.value), _any(key.err, ~F.coalesce(F.map_contains_key(n.value, key.value), F.lit(False))))
            else:
                return n

    def select(self, n: Node, name: str) -> Node:
        if n.kind != "map":
            raise FilterError(f"{name!r} can't be selected from a {n.kind} in {self.text!r}")
        return Node("dyn", F.element_at(n.value, F.lit(name)), _any(n.err, ~F.coalesce(F.map_contains_key(n.value, name), F.lit(False))))

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.choice())
            if self.peek() != ")":
                self.need(",")
        return out

    def call(self, name: str, on: Node) -> Node:
        args = self.arguments()
        text: dict[str, Callable[[Column, Column], Column]] = {"startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains, "matches": F.regexp_like}
        if name == "size" and not args:
            return self.size(on)
        if name not in text or len(args) != 1:
            raise FilterError(f"unknown call {name!r} in {self.text!r}")
        if on.kind not in ("string", "dyn") or args[0].kind not in ("string", "dyn"):
            raise FilterError(f"{name!r} needs text in {self.text!r}")
        return _bool(text[name](on.value, args[0].value), on.err, args[0].err)

    def size(self, n: Node) -> Node:
        if n.kind in ("string", "dyn"):
            return Node("number", F.char_length(n.value).cast("double"), _any(n.err, n.value.isNull()))
        if n.kind == "map":
            return Node("number", F.size(n.value).cast("double"), n.err)
        if n.kind == "list":
            return Node("number", F.lit(float(len(n.items))))
        raise FilterError(f"a {n.kind} has no size in {self.text!r}")

    def primary(self) -> Node:
        kind, value = self.next()
        if kind == "number":
            return Node("number", F.lit(float(value.rstrip("u"))))
        if kind == "string":
            return Node("string", F.lit(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(1)), value[1:-1])))
        if value == "(":
            out = self.choice()
            self.need(")")
            return out
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if self.peek() != "]":
                    self.need(",")
            return Node("list", None, None, tuple(items))
        if kind == "name":
            if value in ("true", "false"):
                return Node("bool", F.lit(value == "true"))
            if value == "null":
                return Node("null", F.lit(None))
            if value in ("op", "schema", "table"):
                return Node("string", F.col(value))
            if value in ("new", "old"):
                return Node("map", F.coalesce(F.col(f"{value}_data"), F.create_map().cast("map<string,string>")))
            if value == "size" and self.peek() == "(":
                args = self.arguments()
                if len(args) == 1:
                    return self.size(args[0])
            if value == "has" and self.peek() == "(":
                args = self.arguments()
                if len(args) == 1 and args[0].kind == "dyn":
                    return Node("bool", F.lit(True) if args[0].err is None else ~args[0].err)
        raise FilterError(f"unexpected {value or 'end'!r} in {self.text!r}")


def compile_filter(text: str) -> Column:
    """A boolean column; a row that can't be evaluated fails the query, as a visible error."""
    node = _Parser(text).whole()
    if node.kind != "bool":
        raise FilterError(f"a filter must be boolean, not a {node.kind}: {text!r}")
    failed = F.raise_error(F.concat(F.lit(f"filter {text!r} can't be evaluated on event "), F.coalesce(F.col("event_id"), F.lit("")))).cast("boolean")
    return F.coalesce(node.value, failed)
