"""Small SQL dialects: one rule text for Spark and its DuckDB twin."""

from __future__ import annotations


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def array(self, items) -> str:
        items = list(items)
        return f"array({', '.join(items)})" if items else "cast(array() as array<string>)"

    def match(self, x: str, p: str) -> str:
        return f"{x} rlike {self.lit('(?iu)' + p)}"

    def extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit('(?iu)' + p)}, {g})"

    def extract_all(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.lit('(?iu)' + p)}, {g})"

    def replace(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)})"

    def filter(self, a: str, v: str, c: str) -> str:
        return f"filter({a}, {v} -> {c})"

    def transform(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def any(self, a: str, v: str, c: str) -> str:
        return f"exists({a}, {v} -> {c})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def first(self, a: str) -> str:
        return f"get({a}, 0)"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def slice(self, a: str, n: int) -> str:
        return f"slice({a}, 1, {n})"

    def concat_lists(self, *a: str) -> str:
        return f"concat({', '.join(a)})"

    def flatten(self, a: str) -> str:
        return f"flatten({a})"

    def compact(self, a: str) -> str:
        return f"array_compact({a})"

    def distinct_sorted(self, a: str) -> str:
        return f"array_sort(array_distinct({a}))"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def fold_distinct(self, a: str) -> str:
        """First spelling of each case-folded value, in order; the array and its folded values are worked out once."""
        kept = "filter(a, (x, i) -> array_position(f, get(f, i)) = i + 1)"
        return f"get(transform(array({a}), a -> get(transform(array(transform(a, y -> lower(y))), f -> {kept}), 0)), 0)"

    def sentences(self, x: str) -> str:
        return f"filter(split({x}, {self.lit('(?<=[.!?;])' + chr(92) + 's+')}), s -> s <> '')"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.lit(p)})"

    def range(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def ints(self) -> str:
        return "cast(array() as array<int>)"

    def days(self, a: str, b: str) -> str:
        return f"timestampdiff(DAY, {a}, {b})"

    def add_hours(self, ts: str, n: str) -> str:
        return f"timestampadd(HOUR, {n}, {ts})"

    def sha1(self, x: str) -> str:
        return f"sha1({x})"

    def contains_list(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def sort_down(self, a: str) -> str:
        return f"sort_array({a}, false)"

    def struct(self, **fields: str) -> str:
        return f"named_struct({', '.join(f'{self.lit(n)}, {e}' for n, e in fields.items())})"

    def whole(self, x: str) -> str:
        """A number as text without places, halves to even."""
        return f"cast(cast(bround({x}, 0) as bigint) as string)"


class Duck(Spark):
    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def array(self, items) -> str:
        items = list(items)
        return f"[{', '.join(items)}]" if items else "[]::varchar[]"

    def match(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit('(?i)' + p)})"

    def extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit('(?i)' + p)}, {g})"

    def extract_all(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.lit('(?i)' + p)}, {g})"

    def replace(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)}, 'g')"

    def filter(self, a: str, v: str, c: str) -> str:
        return f"list_filter({a}, lambda {v}: {c})"

    def transform(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def any(self, a: str, v: str, c: str) -> str:
        return f"len(list_filter({a}, lambda {v}: {c})) > 0"

    def size(self, a: str) -> str:
        return f"len({a})"

    def first(self, a: str) -> str:
        return f"({a})[1]"

    def join(self, a: str, sep: str) -> str:
        return f"coalesce(array_to_string({a}, {self.lit(sep)}), '')"

    def slice(self, a: str, n: int) -> str:
        return f"({a})[1:{n}]"

    def concat_lists(self, *a: str) -> str:
        return "(" + " || ".join(a) + ")"

    def compact(self, a: str) -> str:
        return f"list_filter({a}, lambda z: z is not null)"

    def distinct_sorted(self, a: str) -> str:
        return f"list_sort(list_distinct({a}))"

    def distinct(self, a: str) -> str:
        return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"

    def fold_distinct(self, a: str) -> str:
        return f"list_filter({a}, lambda x, i: list_position(list_transform({a}, lambda y: lower(y)), lower(x)) = i)"

    def sentences(self, x: str) -> str:
        return f"list_filter(string_split(regexp_replace({x}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"

    def split(self, x: str, p: str) -> str:
        return f"regexp_split_to_array({x}, {self.lit(p)})"

    def range(self, a: str, b: str) -> str:
        return f"list_transform(range({a}, {b} + 1), lambda q: q::int)"

    def ints(self) -> str:
        return "[]::int[]"

    def days(self, a: str, b: str) -> str:
        return f"date_sub('day', {a}, {b})"

    def add_hours(self, ts: str, n: str) -> str:
        return f"({ts} + to_hours(({n})::int))"

    def contains_list(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def sort_down(self, a: str) -> str:
        return f"list_sort({a}, 'DESC')"

    def struct(self, **fields: str) -> str:
        return f"struct_pack({', '.join(f'{n} := {e}' for n, e in fields.items())})"

    def whole(self, x: str) -> str:
        return f"round_even({x}, 0)::bigint::varchar"


SPARK, DUCK = Spark(), Duck()
