"""Sizes, limits and blast radius."""

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoreline.functions.text import contains_any, let, longest_prefix, lookup
from shoreline.rules import impact as rules

# Bytes on the wire: signature, else ciphertext, else public key.
DOMINANT = {name: sig or ct or pub for name, pub, sig, ct in rules.SIZES}
# Of two entries the longer name counts, then the alphabetically first.
_BY_LENGTH = sorted(DOMINANT, key=lambda n: (-len(n), n))


def dominant_size(name: Column) -> Column:
    """Bytes of the algorithm whose name starts ``name`` or is started by it."""
    upper = F.upper(name)
    # A table name that starts with the asked name is found from a literal list
    # of all prefixes; the first table entry in order wins.
    by_prefix = {}
    for entry in _BY_LENGTH:
        for i in range(len(entry) + 1):
            by_prefix.setdefault(entry[:i].upper(), entry)
    longer = lookup(longest_prefix(upper, [n.upper() for n in DOMINANT]),
                    {n.upper(): n for n in DOMINANT})
    shorter = lookup(upper, by_prefix)
    order = {n: i for i, n in enumerate(_BY_LENGTH)}
    first = F.when(
        F.coalesce(lookup(shorter, order), F.lit(999)) < F.coalesce(lookup(longer, order), F.lit(999)),
        shorter,
    ).otherwise(longer)
    return F.coalesce(lookup(name, DOMINANT), lookup(first, DOMINANT))


def impact_targets(name: Column) -> Column:
    """Targets of an algorithm in order, by name or by its longest family; NULL if none."""
    lists = F.create_map(*[
        x for k, v in rules.TARGETS.items()
        for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))
    ])
    families = {k.upper(): k for k in rules.TARGETS}
    family = lookup(longest_prefix(F.upper(name), families), families)
    return F.coalesce(F.try_element_at(lists, name), F.try_element_at(lists, family))


def encoded_size(n: Column, encoding: Column) -> Column:
    """Bytes of ``n`` raw bytes in base64, hex, PEM, DER or as they are."""
    base64 = F.ceil(n / 3) * 4
    return (
        F.when(encoding == "base64", base64)
        .when(encoding == "hex", n * 2)
        .when(encoding == "pem", base64 + F.ceil(base64 / 64) + 52)
        .when(encoding == "der", n + 8)
        .otherwise(n)
    ).cast("bigint")


def consumer_type(message: Column) -> Column:
    """What the code at a flow step does with the value."""
    lower = F.lower(message)
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in rules.CONSUMERS:
        out = out.when(contains_any(lower, [w.lower() for w in words]), kind)
    return out.otherwise("assignment")


def protocol_calls(message: Column) -> Column:
    """Protocols whose APIs a message names, in alphabetical order."""
    return F.array_compact(F.array(*[
        F.when(contains_any(message, rules.PROTOCOL_CALLS[p]), p)
        for p in sorted(rules.PROTOCOL_CALLS)
    ]))


def protocol_limit(protocol: Column) -> Column:
    return lookup(F.upper(protocol), {p.upper(): n for p, n, _, _ in rules.PROTOCOL_LIMITS})


def protocol_hard_limit(protocol: Column) -> Column:
    return lookup(F.upper(protocol), {p.upper(): h for p, _, h, _ in rules.PROTOCOL_LIMITS})


def protocol_encoding(protocol: Column) -> Column:
    return lookup(F.upper(protocol), {p.upper(): e for p, _, _, e in rules.PROTOCOL_LIMITS})


def size_limits(message: Column) -> Column:
    """Positive size limits written in a message, as ``struct<type, max_bytes>``.

    The message is cut into words and signs.  A number is a limit by what stands around
    it: the size of a byte slice or array that is made, the length of a VARCHAR column,
    or what is assigned to a length setting or to a constant with MAX inside its name.
    """
    def found(t):
        def at(i, before):
            return F.get(t, i - before)

        def follows(i, words):
            """The words stand right before the number at place i."""
            tests = [at(i, len(words) - n) == w for n, w in enumerate(words)]
            return functools.reduce(operator.and_, tests)

        assigned = lambda i: at(i, 1) == "="
        readers = [
            ("buffer-alloc", lambda i: follows(i, ["make", "(", "[", "]", "byte", ","]) & (at(i, -1) == ")"), True),
            ("buffer-alloc", lambda i: follows(i, ["new", "byte", "["]) & (at(i, -1) == "]"), True),
            ("db-column", lambda i: at(i, 2).endswith("VARCHAR") & (at(i, 1) == "(") & (at(i, -1) == ")"), True),
            ("config", lambda i: assigned(i) & at(i, 2).endswith("max_len"), False),
            ("constant", lambda i: assigned(i) & F.substr(at(i, 2), F.lit(2), F.length(at(i, 2)) - 2).contains("_MAX_"), False),
        ]

        def of(kind, test, whole):
            number = "^[0-9]+$" if whole else "^[0-9]"
            places = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: F.coalesce(
                F.get(t, i).rlike(number) & test(i), F.lit(False)))
            sizes = F.transform(places, lambda i: F.regexp_extract(F.get(t, i), "^[0-9]+", 0).try_cast("bigint"))
            return F.transform(F.filter(sizes, lambda n: n > 0), lambda n: F.named_struct(
                F.lit("type"), F.lit(kind), F.lit("max_bytes"), n))

        return F.concat(*[of(*r) for r in readers])

    nothing = F.array().cast("array<struct<type:string,max_bytes:bigint>>")
    # most messages hold none of the words that a limit needs
    return F.when(contains_any(message, ["byte", "VARCHAR", "max_len", "_MAX_"]) & message.rlike("[0-9]"), let(F.regexp_extract_all(message, F.lit(r"\w+|\S"), F.lit(0)), found)).otherwise(nothing)


def blast_radius(hops: Column, limits: Column, protocols: Column, ratio: Column) -> Column:
    """Score from 0 to 100: 20% hops, 35% limits, 25% protocols, 20% growth."""
    def capped(c, top):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(top))

    raw = (
        capped(hops / 10.0, 1.0) * 100.0 * 0.20
        + capped(limits * 25.0, 100.0) * 0.35
        + capped(protocols * 33.0, 100.0) * 0.25
        + capped(ratio / 50.0, 1.0) * 100.0 * 0.20
    )
    return F.floor(raw + 0.5).cast("int")


def blast_grade(score: Column) -> Column:
    out = F.when(score <= rules.BLAST_GRADES[0][0], rules.BLAST_GRADES[0][1])
    for top, word in rules.BLAST_GRADES[1:]:
        out = out.when(score <= top, word)
    return out.otherwise("Critical")
