"""The few places where Spark's SQL and the checking engine's differ.

Queries are SQL texts, built by functions of a dialect. Spark runs them over the tables of a folder;
the other form of the same text is what results are checked against.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def text(s: str) -> str:
        return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'

    def matches(self, e: str, pattern: str) -> str:
        return f"regexp_like({e}, {self.text(pattern)})"

    def extract(self, e: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({e}, {self.text(pattern)}, {group})"

    def extract_all(self, e: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({e}, {self.text(pattern)}, {group})"

    def replace(self, e: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({e}, {self.text(pattern)}, {self.text(by)})"

    def split(self, e: str, pattern: str) -> str:
        return f"split({e}, {self.text(pattern)})"

    def joined(self, e: str, by: str = ",") -> str:
        return f"array_join(sort_array(collect_set({e})), '{by}')"

    def join_array(self, e: str, by: str = " ") -> str:
        return f"array_join({e}, '{by}')"

    def size(self, e: str) -> str:
        return f"CAST(size({e}) AS BIGINT)"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def unnest(self, table: str, array: str, where: str = "true") -> str:
        """Rows of the table with columns ``pos`` (from 1) and ``val`` for the array's elements."""
        return f"(SELECT t.*, CAST(u.pos AS BIGINT) + 1 AS pos, u.val AS val FROM {table} t LATERAL VIEW posexplode({array}) u AS pos, val WHERE {where})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def any_of(self, array: str, test: str) -> str:
        """test: an expression of ``x``."""
        return f"exists({array}, x -> {test})"

    def keep(self, array: str, test: str) -> str:
        return f"filter({array}, x -> {test})"

    def apply(self, array: str, made: str) -> str:
        return f"transform({array}, x -> {made})"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def at(self, array: str, k: int) -> str:
        return f"try_element_at({array}, {k})"

    def slice(self, array: str, n: int | str) -> str:
        return f"slice({array}, 1, {n})"

    def last(self, array: str) -> str:
        return f"try_element_at({array}, -1)"

    def millis(self, e: str) -> str:
        return f"unix_millis(CAST({e} AS TIMESTAMP))"

    def day(self, e: str) -> str:
        return f"CAST(date_diff(CAST({e} AS DATE), DATE '1970-01-01') AS BIGINT)"

    def unquote(self, e: str) -> str:
        return f"coalesce(try_url_decode(replace({e}, '+', '%20')), {e})"

    def unbase64(self, e: str) -> str:
        """The text that base64, with its end marks, stands for; null if there is none."""
        return f"CAST(try_to_binary({e}, 'base64') AS STRING)"

    def chars(self, e: str) -> str:
        return f"filter(split({e}, ''), x -> x <> '')"

    def long(self, value: int) -> str:
        return f"CAST({value} AS BIGINT)"

    def struct(self, fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def let(self, e: str, name: str, made: str) -> str:
        """made: an expression of ``name``, which stands for e; e is written and computed once."""
        return f"element_at(transform(array({e}), {name} -> {made}), 1)"

    def fold(self, array: str, first: str, acc: str, item: str, step: str) -> str:
        return f"aggregate({array}, {first}, ({acc}, {item}) -> {step})"

    def inserted(self, array: str, at: str, e: str) -> str:
        """The array with e before the element at an index from 0."""
        return f"concat(slice({array}, 1, CAST({at} AS INT)), array({e}), slice({array}, CAST({at} AS INT) + 1, size({array})))"

    def from_points(self, array: str) -> str:
        return f"decode(unhex(array_join(transform({array}, p -> lpad(hex(p), 8, '0')), '')), 'UTF-32')"


class Duck(Spark):
    name = "duckdb"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def matches(self, e: str, pattern: str) -> str:
        return f"regexp_matches({e}, {self.text(pattern)})"

    def replace(self, e: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({e}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def split(self, e: str, pattern: str) -> str:
        return f"regexp_split_to_array({e}, {self.text(pattern)})"

    def joined(self, e: str, by: str = ",") -> str:
        return f"coalesce(array_to_string(list_sort(list(DISTINCT {e})), '{by}'), '')"

    def join_array(self, e: str, by: str = " ") -> str:
        return f"array_to_string({e}, '{by}')"

    def size(self, e: str) -> str:
        return f"CAST(len({e}) AS BIGINT)"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def unnest(self, table: str, array: str, where: str = "true") -> str:
        # the array's columns are found in t
        return f"(SELECT * FROM (SELECT t.*, unnest(generate_series(1, len({array}))) AS pos, unnest({array}) AS val FROM {table} t) WHERE {where})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def any_of(self, array: str, test: str) -> str:
        return f"(len(list_filter({array}, lambda x: {test})) > 0)"

    def keep(self, array: str, test: str) -> str:
        return f"list_filter({array}, lambda x: {test})"

    def apply(self, array: str, made: str) -> str:
        return f"list_transform({array}, lambda x: {made})"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def at(self, array: str, k: int) -> str:
        return f"({array})[{k}]"

    def slice(self, array: str, n: int | str) -> str:
        return f"({array})[1:{n}]"

    def last(self, array: str) -> str:
        return f"({array})[-1]"

    def millis(self, e: str) -> str:
        return f"(epoch_us({e}) // 1000)"

    def day(self, e: str) -> str:
        return f"CAST(date_diff('day', DATE '1970-01-01', CAST({e} AS DATE)) AS BIGINT)"

    def unquote(self, e: str) -> str:
        return f"url_decode(replace({e}, '+', '%20'))"

    def unbase64(self, e: str) -> str:
        return f"TRY(decode(from_base64({e})))"

    def chars(self, e: str) -> str:
        return f"list_filter(string_split({e}, ''), lambda x: x <> '')"

    def struct(self, fields: dict[str, str]) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def let(self, e: str, name: str, made: str) -> str:
        return f"list_transform([{e}], lambda {name}: {made})[1]"

    def fold(self, array: str, first: str, acc: str, item: str, step: str) -> str:
        return f"list_reduce({array}, lambda {acc}, {item}: {step}, {first})"

    def inserted(self, array: str, at: str, e: str) -> str:
        return f"list_concat(list_concat(({array})[1:{at}], [{e}]), ({array})[{at} + 1:])"

    def from_points(self, array: str) -> str:
        return f"array_to_string(list_transform({array}, lambda p: chr(CAST(p AS INTEGER))), '')"


def values(columns: str, rows: list[tuple], d: Spark) -> str:
    """A table of constants; columns: their names, comma-separated."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}e0"
        return d.text(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"
