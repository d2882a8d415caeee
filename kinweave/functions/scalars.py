"""Column expressions: ids and addresses, operands, tokens, ratios, set and multiset similarity, decisions.

All of them are built-in expressions, so they stay inside code generation wherever they are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is added to an address in an id.
ID_BIAS = 0x100000
#: Widths of registers by name.
REGISTER_WIDTHS = {
    **{r: 64 for r in ("rax", "rbx", "rcx", "rdx", "rsi", "rdi", "rbp", "rsp", *(f"r{i}" for i in range(8, 16)))},
    **{r: 32 for r in ("eax", "ebx", "ecx", "edx", "esi", "edi", "ebp", "esp", *(f"r{i}d" for i in range(8, 16)))},
    **{r: 16 for r in ("ax", "bx", "cx", "dx", "si", "di", "bp", "sp", *(f"r{i}w" for i in range(8, 16)))},
    **{r: 8 for r in ("al", "bl", "cl", "dl", "ah", "bh", "ch", "dh", "sil", "dil", "bpl", "spl", *(f"r{i}b" for i in range(8, 16)))},
}
#: Widths of memory operands by size word.
MEMORY_WIDTHS = {"byte": 8, "word": 16, "dword": 32, "qword": 64, "tbyte": 80, "oword": 128, "xmmword": 128, "ymmword": 256, "zmmword": 512}
#: Branch mnemonics that don't start with j.
LOOPS = ("loop", "loope", "loopne", "loopz", "loopnz")




# ids and addresses


def function_id(address: Column, bias: int = ID_BIAS) -> Column:
    """FUN_ and the biased address in at least eight hexadecimal digits."""
    return F.concat(F.lit("FUN_"), F.format_string("%08x", address.cast("long") + F.lit(bias)))


def hex_address(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(address.cast("long"))))


def hex_value(text: Column) -> Column:
    """DECIMAL(20, 0) of an unsigned hexadecimal text without prefix."""
    return F.conv(text, 16, 10).cast("decimal(20,0)")


def address_of_id(member: Column, bias: int = ID_BIAS) -> Column:
    """The address in an id; null where it is none."""
    digits = F.regexp_extract(member, r"^FUN_([0-9a-fA-F]{8,16})$", 1)
    return F.when(digits != "", hex_value(digits) - F.lit(bias))


def parse_integer(text: Column) -> Column:
    """DECIMAL(20, 0) of a decimal or 0x number with an optional sign; null for anything else, 007 included."""
    t = F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit(""))
    sign = F.when(F.startswith(t, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_extract(t, r"^[+-]?0x([0-9a-f]+)$", 1)
    plain = F.regexp_extract(t, r"^[+-]?(0+|[1-9][0-9]*)$", 1)
    return F.when(digits != "", sign * hex_value(digits)).when(plain != "", sign * plain.try_cast("decimal(20,0)")).cast("decimal(20,0)")


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair as (smaller, larger)."""
    return F.least(a, b), F.greatest(a, b)


def is_sha256(text: Column, any_case: bool = False) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$" if any_case else "^[0-9a-f]{64}$")


def canonical_sha256(value: Column) -> Column:
    """SHA-256 of a value's compact JSON. Structs must list their fields in the order wanted."""
    return F.sha2(F.to_json(value), 256)


def family_id(members: Column) -> Column:
    return F.concat(F.lit("family_"), canonical_sha256(F.array_sort(members)))


# operands


def split_operands(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(t, ","), lambda x: F.trim(x)))


def _lookup(key: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def register_width(operand: Column) -> Column:
    """Bits of a register by its name, vector, mask and stack registers included; null if unknown."""
    name = F.lower(F.trim(operand))
    wide = F.when(name.rlike(r"^(xmm|bnd)[0-9]+$"), 128).when(name.rlike(r"^ymm[0-9]+$"), 256).when(name.rlike(r"^zmm[0-9]+$"), 512).when(name.rlike(r"^(mm|k)[0-9]+$"), 64).when(name.rlike(r"^st(\([0-7]\)|[0-7])$"), 80)
    return F.coalesce(_lookup(name, REGISTER_WIDTHS), wide)


def memory_width(operand: Column) -> Column:
    word = F.regexp_extract(F.lower(operand), r"\b(" + "|".join(MEMORY_WIDTHS) + r")\s+ptr\b", 1)
    return _lookup(word, MEMORY_WIDTHS)


def rip_displacement(operand: Column) -> Column:
    """Signed displacement of [rip +- n]; null for other operands."""
    pattern = r"\[\s*rip\s*([+-])\s*(0x[0-9a-fA-F]+|[0-9]+)\s*\]"
    value = parse_integer(F.regexp_extract(operand, pattern, 2))
    return F.when(F.regexp_extract(operand, pattern, 1) == "-", -value).otherwise(value)


def normalize_operand(operand: Column, kind: Column, own_width: Column, mnemonic: Column) -> Column:
    """The class of an operand: register width, size of immediate, kind of memory. own_width: of the instruction's first register."""
    value, low = parse_integer(operand), F.lower(operand)
    width = F.coalesce(memory_width(operand), own_width, F.when(mnemonic == "LEA", 64))
    place = F.when(F.contains(low, F.lit("rip")), "ip_data_slot").when(low.rlike("[re][sb]p"), "stack").otherwise("general_pointer")
    return (
        F.when(kind == "register", F.concat(F.lit("reg"), F.coalesce(register_width(operand).cast("string"), F.lit("unknown"))))
        .when((kind == "immediate") & value.isNull(), "imm_unknown")
        .when(kind == "immediate", F.when(F.abs(value) <= 0xFFFFF, "imm_small").otherwise("imm_address_like"))
        .when(kind == "memory", F.concat(place, F.coalesce(width.cast("string"), F.lit(""))))
        .otherwise("unknown")
    )


def is_branch(mnemonic: Column) -> Column:
    return F.startswith(mnemonic, F.lit("j")) | mnemonic.isin(*LOOPS)


def operand_kind(code: Column, immediate: int, memory: int, register: int) -> Column:
    return F.when(code == immediate, "immediate").when(code == memory, "memory").when(code == register, "register").otherwise("unknown")


# tokens and shapes


def instruction_token(mnemonic: Column, operands: Column) -> Column:
    return F.concat_ws(" ", mnemonic, operands)


def retrieval_token(mnemonic: Column, operands: Column, constants: Column, flow: Column) -> Column:
    part = lambda a: F.coalesce(F.nullif(F.array_join(a, ","), F.lit("")), F.lit("-"))
    return F.concat_ws("|", mnemonic, part(operands), part(constants), flow)


def operand_shape(value: Column) -> Column:
    t = F.lower(F.trim(value))
    width = F.regexp_extract(t, "(8|16|32|64|128|256)", 1)
    return (
        F.when(t == "", "unknown")
        .when(t.rlike(r"^((r|e)?(ax|bx|cx|dx|si|di|sp|bp|ip)|r(1[0-5]|[0-9])|[abcd]l|[abcd]h)$"), "reg")
        .when(t.rlike("^(reg|xmm|ymm)"), t)
        .when(F.startswith(t, F.lit("mem")) | F.contains(t, F.lit("[")) | F.contains(t, F.lit(" ptr ")), F.concat(F.lit("mem"), width))
        .when(t.rlike("^(imm|const)"), t)
        .when(F.startswith(t, F.lit("call_")) | t.isin("call_target", "branch_target"), "target")
        .when(t.rlike(r"^([-+]?0x[0-9a-f]+|[-+]?[0-9]+)$"), "imm")
        .otherwise(t)
    )


def length_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 4, "1-4").when(n <= 16, "5-16").when(n <= 64, "17-64").otherwise("65+")


def integer_shape(n: Column) -> Column:
    return F.when(n == 0, "int:zero").when(n == 1, "int:one").when(F.abs(n) < 256, "int:small").otherwise("int:large")


def constant_shape(text: Column) -> Column:
    """Of a constant in text: integers by size, others by length."""
    t = F.lower(F.trim(text))
    number = t.rlike(r"^([-+]?0x[0-9a-f]+|[-+]?[0-9]+)$")
    value = parse_integer(t)
    return F.when(number & value.isNull(), "number").when(number, integer_shape(value)).otherwise(F.concat(F.lit("str:"), length_bucket(F.length(t))))


def control_flow_shape(value: Column) -> Column:
    t = F.lower(F.coalesce(value, F.lit("other")))
    has = lambda s: F.contains(t, F.lit(s))
    return F.when(has("return") | t.isin("ret", "terminal"), "return").when(has("conditional") | has("branch"), "conditional").when(has("jump"), "jump").when(has("call"), "call").otherwise("fallthrough")


# names


def is_import(name: Column, kind: Column) -> Column:
    return F.startswith(name, F.lit("sym.imp.")) | kind.isin("sym", "import")


def owner_from_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?:^|<)(core|alloc|std|__rustc)::", 1), F.lit(""))


def analysis_status(imported: Column, kind: Column, size: Column, complete: Column) -> Column:
    """external, address-only, complete or incomplete; an error for an internal function without a body record."""
    return (
        F.when(imported, "external")
        .when((kind == "opaque") | (size <= 0), "address-only")
        .when(complete.isNull(), F.raise_error(F.lit("no body evidence for an internal function")))
        .when(complete, "complete")
        .otherwise("incomplete")
    )


def grouping_role(status: Column, is_root: Column) -> Column:
    return F.when(is_root | status.isin("external", "address-only"), "context-only").when(status == "incomplete", "abstain").otherwise("member")


def context_colour(is_root: Column, imported: Column, name: Column, address: Column) -> Column:
    return F.when(is_root, "root").when(imported, F.concat(F.lit("import:"), name)).otherwise(F.concat(F.lit("opaque:"), F.lower(F.hex(address.cast("long")))))


# similarity


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; 1 for two zeros."""
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def ngrams(items: Column, size: int = 3) -> Column:
    """array of arrays; a shorter array that holds anything is one n-gram."""
    whole = F.transform(F.sequence(F.lit(1), F.size(items) - size + 1), lambda i: F.slice(items, i, size))
    return F.when(F.size(items) >= size, whole).when(F.size(items) > 0, F.array(items)).otherwise(F.slice(F.array(items), 1, 0))


def counts(items: Column) -> Column:
    """MAP of the occurrences of each item."""
    distinct = F.array_distinct(items)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda x: F.size(F.filter(items, lambda y: y == x)).cast("long")))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two MAP<key, count>; 1 if both are empty."""
    both = F.map_values(F.map_zip_with(a, b, lambda _k, x, y: F.struct(F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("lo"), F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("hi"))))
    low = F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + x["lo"])
    high = F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + x["hi"])
    return F.when(high == 0, 1.0).otherwise(low / high)


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 1 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def slot_similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard, but null if both are empty: no evidence is not agreement."""
    x, y = F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0))
    return F.when((x <= 0) & (y <= 0), F.lit(None).cast("double")).when((x <= 0) | (y <= 0), 0.0).otherwise(multiset_jaccard(a, b))


def precise_sum(values: Sequence[Column] | Column) -> Column:
    """Sum of doubles with a running compensation, nulls left out."""
    items = values if isinstance(values, Column) else F.array(*values)
    items = F.filter(items, lambda x: x.isNotNull())
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc: Column, x: Column) -> Column:
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(items, start, add, lambda acc: acc["s"] + acc["c"])


def precise_mean(values: Sequence[Column]) -> Column:
    items = F.filter(F.array(*values), lambda x: x.isNotNull())
    return precise_sum(items) / F.size(items)


def same(a: Column, b: Column) -> Column:
    """Three-valued equality: null where either is unknown."""
    return a == b


# decisions


def match_decision(structure: Column, constants: Column, data: Column, both_complete: Column, opaque: Column, config: PairPolicy) -> Column:
    """abstain, reject, match or unknown, in that order of precedence."""
    slots = F.filter(F.array(constants, data), lambda x: x.isNotNull())
    informed = (F.size(slots) > 0) if config.require_informative_slot else F.lit(True)
    agree = F.forall(slots, lambda x: x >= config.slot_match)
    out = F.when(~both_complete, "abstain")
    if config.abstain_on_opaque:
        out = out.when(opaque > 0, "abstain")
    if config.structure_reject is not None:
        out = out.when(structure <= config.structure_reject, "reject")
    return out.when((structure >= config.structure_match) & informed & agree, "match").otherwise("unknown")


def match_margin(structure: Column, constants: Column, data: Column, config: PairPolicy) -> Column:
    """How far the weakest criterion of a match is above its threshold."""
    least = F.least(structure - config.structure_match, constants - config.slot_match, data - config.slot_match)
    if config.require_informative_slot:
        return F.when(constants.isNull() & data.isNull(), F.lit(float("-inf"))).otherwise(least)
    return least


class PairPolicy:
    """Thresholds in [0, 1], switches, and two ceilings (None: no ceiling)."""

    def __init__(self, structure_match: float = 0.95, slot_match: float = 1.0, structure_reject: float | None = None, require_informative_slot: bool = True, abstain_on_opaque: bool = True, max_comparisons: int | None = 10_000, max_cells: int | None = 500_000_000):
        for name, value in (("structure_match", structure_match), ("slot_match", slot_match), ("structure_reject", structure_reject)):
            if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1):
                raise ValueError(f"{name} must be a number from 0 to 1")
        for name, value in (("max_comparisons", max_comparisons), ("max_cells", max_cells)):
            if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
                raise ValueError(f"{name} must be a whole number from 0 on")
        if structure_reject is not None and structure_reject >= structure_match:
            raise ValueError("structure_reject must be below structure_match")
        self.structure_match, self.slot_match, self.structure_reject = float(structure_match), float(slot_match), structure_reject
        self.require_informative_slot, self.abstain_on_opaque = bool(require_informative_slot), bool(abstain_on_opaque)
        self.max_comparisons, self.max_cells = max_comparisons, max_cells

    def fits(self, comparisons: int, cells: int) -> bool:
        return (self.max_comparisons is None or comparisons <= self.max_comparisons) and (self.max_cells is None or cells <= self.max_cells)


def neutral_label(left_ids: Column, left_origins: Column, right_ids: Column, right_origins: Column) -> Column:
    """Why a pair can't be judged: unresolved, ambiguous or duplicate; null if it can."""
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    left, right = F.array_distinct(left_origins), F.array_distinct(right_origins)
    return (
        F.when(empty(left_ids) | empty(right_ids) | empty(left) | empty(right), "unresolved")
        .when((F.size(left) > 1) | (F.size(right) > 1), "ambiguous")
        .when(left[0] != right[0], F.lit(None).cast("string"))
        .when(F.arrays_overlap(left_ids, right_ids), "duplicate")
    )


def precision(correct: Column, wrong: Column, digits: int = 4) -> Column:
    n = correct + wrong
    return F.when(n > 0, F.round(correct / n, digits))


def f1(p: Column, r: Column, digits: int = 4) -> Column:
    """Null if either is undefined, 0 if either is zero."""
    return F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).when((p == 0) | (r == 0), 0.0).otherwise(F.round(2 * p * r / (p + r), digits))
