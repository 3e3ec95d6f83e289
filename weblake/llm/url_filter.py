"""URL filters: rules kept in a cascade of Bloom filters that is exact over all keys of the corpus."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weblake.llm.common import free_names
from weblake.session import Work

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits in a byte of a filter: one less than 8, so that each byte is a character that ``ascii`` reads.
BITS = 7
#: False-positive rate from the second level on.
LATER_RATE = 0.5


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def _rest(url: str) -> str:
    return f"case when instr({url}, '://') > 0 then substring({url}, instr({url}, '://') + 3) else '' end"


def host_of(url: str = "url") -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.expr(f"translate(regexp_extract({_rest(url)}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}')")


def path_of(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.expr(f"regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1)")


def rule_keys(shapes: Sequence[tuple[int, int]]) -> Column:
    """Every string that a rule fitting ``host`` and ``path`` can have.

    A rule with m host labels and n path characters fits exactly if it is the last m labels and the
    first n characters, so the (m, n) of the rules are all the shapes there are.
    """
    cut = ", ".join(f"""case when size(split(host, '[.]')) >= {m} and char_length(path) >= {n}
        then concat(substring_index(host, '.', -{m}), substring(path, 1, {n})) end""" for m, n in shapes)
    return F.expr(f"array_compact(array({cut}))")


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter as bytes of :data:`BITS` bits, with ``hashes`` positions a key."""

    data: bytes
    hashes: int
    salt: int

    @staticmethod
    def positions(key: str, size: int, hashes: int, salt: int) -> str:
        """SQL of the bit positions of a key (double hashing)."""
        one, two = (f"pmod(xxhash64({key}, {salt}, {i}), {size}L)" for i in (0, 1))
        return f"transform(sequence(0, {hashes - 1}), i -> ({one} + i * {two}) % {size}L)"

    @classmethod
    def build(cls, keys: DataFrame, count: int, rate: float, salt: int, max_bytes: int) -> Bloom:
        """Filter of ``count`` keys (key). Its bytes meet on the driver: their number is set by ``count``
        and ``rate`` before, and more than ``max_bytes`` is an error."""
        size = max(64, math.ceil(count * -math.log(rate) / math.log(2) ** 2))
        hashes = max(1, round(size / max(1, count) * math.log(2)))
        hashes = min(hashes, max(1, round(-math.log2(rate))))
        length = size // BITS + 1
        if length > max_bytes:
            raise ValueError(f"a filter of {length} bytes is over the limit of {max_bytes}")
        bits = keys.select(F.explode(F.expr(cls.positions("key", size, hashes, salt))).alias("at")).groupBy(
            F.expr(f"at div {BITS}").alias("byte")).agg(F.expr(f"bit_or(shiftleft(1, cast(at % {BITS} as int)))").alias("bits"))
        data = bytearray(length)
        for row in bits.toLocalIterator():
            data[row.byte] = row.bits
        return cls(bytes(data), hashes, salt | size << 8)

    def holds(self, key: Column) -> Column:
        """True where the filter has all bits of the key."""
        size, salt = self.salt >> 8, self.salt & 255
        one, two = (F.pmod(F.xxhash64(key, F.lit(salt), F.lit(i)), F.lit(size).cast("bigint")) for i in (0, 1))

        def bit(i):
            at = (one + i * two) % F.lit(size).cast("bigint")
            byte = F.ascii(F.substring(F.lit(self.data), (at / BITS).cast("bigint").cast("int") + 1, F.lit(1)).cast("string"))
            return F.call_function("shiftright", byte, (at % BITS).cast("int")).bitwiseAND(F.lit(1)) == 1
        return F.forall(F.sequence(F.lit(0), F.lit(self.hashes - 1)), bit)


@dataclass(frozen=True)
class Cascade:
    """Bloom filters whose levels hold, in turn, listed keys and other keys that the level before lets pass."""

    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        """True for the listed keys, false for every other key of the universe that the cascade was built on."""
        found = F.lit(True)
        for level in reversed(self.levels[1:]):
            found = ~(level.holds(key) & found)
        return self.levels[0].holds(key) & found


def build_cascades(work: Work, lists: dict[str, Sequence[str]], universe: DataFrame,
                   max_bytes: int = 64 << 20) -> dict[str, Cascade]:
    """One exact cascade for each list of keys over all keys (key) of ``universe``, repeats allowed.

    The first level lets about as many unlisted keys pass as the list is long; only those are
    shuffled. Later levels hold ever smaller remainders until none is left.
    """
    spark = work.spark
    listed = {name: sorted(set(keys)) for name, keys in lists.items()}
    tables = {name: spark.createDataFrame([(k,) for k in keys], "key string") for name, keys in listed.items() if keys}
    total = universe.agg(F.approx_count_distinct("key")).first()[0]
    first = {name: Bloom.build(df, len(listed[name]), min(0.25, len(listed[name]) / max(1, total)), 1, max_bytes)
             for name, df in tables.items()}
    passing = F.array_compact(F.array(*(F.when(bloom.holds(F.col("key")), F.lit(name)) for name, bloom in first.items())))
    suspects = work.table("suspects", universe.select("key", passing.alias("lists")).filter(F.size("lists") > 0).distinct())
    cascades = {}
    for name, df in tables.items():
        known = df.withColumn("_listed", F.lit(True))
        outside = suspects.filter(F.array_contains("lists", name)).join(known, "key", "left").filter("_listed is null").select("key")
        levels, inside, outside = [first[name]], df, work.table(f"{name}_1", outside)
        while (count := outside.count()) > 0:
            level = Bloom.build(outside, count, LATER_RATE, len(levels) + 1, max_bytes)
            levels.append(level)
            left = work.table(f"{name}_{len(levels)}", inside.filter(level.holds(F.col("key"))))
            inside, outside = outside, left
        cascades[name] = Cascade(tuple(levels))
    return cascades


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict (existing columns of these names are replaced).

    The longest rule that fits wins; at equal length block wins. Where no rule fits, no key of the
    URL is in a cascade and the verdict is ``default``. A null URL or one without ``://`` has an
    empty host and path, which no rule fits. Repeated rows are judged each by itself; an empty table
    gives no rows. No join: the filters are constants of the expression, bounded when they are built.
    """
    work = Work(pages.sparkSession, "urls")
    shapes = sorted({(len(r.host.split(".")), len(r.path)) for r in rules})
    parts = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    if not shapes:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    universe = parts.select(F.explode(rule_keys(shapes)).alias("key"))
    lists = {verdict: [r.key for r in rules if r.verdict == verdict] for verdict in ("allow", "block")}
    cascades = build_cascades(work, lists, universe)

    def judged(key):
        verdict = F.coalesce(*(F.when(cascades[v].holds(key), F.lit(v)) for v in ("block", "allow") if v in cascades))
        return F.struct(F.length(key).alias("length"), verdict.alias("verdict"), key.alias("rule"))

    best = F.array_max(F.filter(F.transform(rule_keys(shapes), judged), lambda x: x["verdict"].isNotNull()))
    name, = free_names(parts.columns, "best_rule")
    return (parts.withColumn(name, best)
            .withColumns({"rule": F.col(f"{name}.rule"), "verdict": F.coalesce(f"{name}.verdict", F.lit(default))}).drop(name))
