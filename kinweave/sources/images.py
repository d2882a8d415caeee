"""Executable images as tables: segments, relocations, imports, and bytes at addresses.

Headers of ELF64 and PE32+ files are fixed structures of a few hundred bytes; a file is one row of Spark's
binaryFile source and is parsed where it lies. Disassembly stays outside: decoders deliver the tables
function, transfer and instruction, and decode() runs one that is installed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import discovery

#: Fixed values of the ELF format: machine, segment and relocation types, flags.
ELF_X86_64, PT_LOAD, PF_X = 62, 1, 1
SHT_RELA, SHN_UNDEF = 4, 0
RELATIVE, SYMBOLIC = 8, (1, 6, 7)
#: Fixed values of the PE format.
PE32_PLUS, IMAGE_AMD64, SCN_EXECUTE, DIR64 = 0x20B, 0x8664, 0x20000000, 10
MASK = (1 << 64) - 1


class NotAnImage(ValueError):
    """Neither a 64-bit x86 ELF nor PE file."""


def parse_elf(raw: bytes) -> dict:
    """entry, segments (start, size, file_offset, file_size, executable), relocations (slot, target)."""
    if raw[:4] != b"\x7fELF" or len(raw) < 64 or raw[4] != 2:
        raise NotAnImage("not a 64-bit ELF file")
    kind, machine = struct.unpack_from("<HH", raw, 16)
    entry, phoff, shoff = struct.unpack_from("<QQQ", raw, 24)
    phsize, phnum, shsize, shnum = struct.unpack_from("<HHHH", raw, 54)
    if machine != ELF_X86_64 or kind not in (2, 3):
        raise NotAnImage("not an x86-64 executable")
    segments = []
    for i in range(phnum):
        p_type, flags, offset, vaddr, _, filesz, memsz, _ = struct.unpack_from("<IIQQQQQQ", raw, phoff + i * phsize)
        if p_type == PT_LOAD:
            segments.append({"start": vaddr, "size": memsz, "file_offset": offset, "file_size": filesz, "executable": bool(flags & PF_X)})
    sections = [struct.unpack_from("<IIQQQQIIQQ", raw, shoff + i * shsize) for i in range(shnum)] if shoff else []
    relocations = []
    for s in sections:
        if s[1] != SHT_RELA:
            continue
        linked = sections[s[6]] if s[6] < len(sections) else None
        for at in range(s[4], s[4] + s[5], 24):
            slot, info, addend = struct.unpack_from("<QQq", raw, at)
            what, symbol = info & 0xFFFFFFFF, info >> 32
            if what == RELATIVE:
                relocations.append({"slot": slot, "target": addend & MASK})
            elif what in SYMBOLIC and linked:
                _, _, _, index, value, _ = struct.unpack_from("<IBBHQQ", raw, linked[4] + 24 * symbol)
                if index != SHN_UNDEF:
                    relocations.append({"slot": slot, "target": (value + addend) & MASK})
    return {"entry": entry, "segments": segments, "relocations": relocations, "imports": [], "boundaries": []}


def parse_pe(raw: bytes) -> dict:
    """The same of a PE32+ file, with imports (slot, name) and boundaries (start, end) of its exception table."""
    at = struct.unpack_from("<I", raw, 0x3C)[0] if raw[:2] == b"MZ" and len(raw) > 0x40 else -1
    if at < 0 or raw[at : at + 4] != b"PE\0\0":
        raise NotAnImage("not a PE file")
    machine, n_sections = struct.unpack_from("<HH", raw, at + 4)
    optional_size = struct.unpack_from("<H", raw, at + 20)[0]
    o = at + 24
    if machine != IMAGE_AMD64 or struct.unpack_from("<H", raw, o)[0] != PE32_PLUS:
        raise NotAnImage("not a PE32+ file for x86-64")
    entry, base = struct.unpack_from("<I", raw, o + 16)[0], struct.unpack_from("<Q", raw, o + 24)[0]
    n_dirs = struct.unpack_from("<I", raw, o + 108)[0]
    dirs = [struct.unpack_from("<II", raw, o + 112 + 8 * i) for i in range(n_dirs)]
    sections = []
    for i in range(n_sections):
        vsize, rva, size, offset = struct.unpack_from("<IIII", raw, o + optional_size + 40 * i + 8)
        flags = struct.unpack_from("<I", raw, o + optional_size + 40 * i + 36)[0]
        sections.append((rva, max(vsize, size), offset, size, flags))

    def place(rva: int) -> int | None:
        return next((off + rva - start for start, _, off, size, _ in sections if start <= rva < start + size), None)

    def text(rva: int) -> str:
        p = place(rva)
        return raw[p : raw.index(b"\0", p)].decode("latin-1") if p is not None else ""

    imports, boundaries, relocations = [], [], []
    if len(dirs) > 1 and dirs[1][0]:
        p = place(dirs[1][0])
        while p is not None and any(row := struct.unpack_from("<IIIII", raw, p)):
            names, dll, slots = row[0] or row[4], text(row[3]), row[4]
            k = 0
            while (q := place(names + 8 * k)) is not None and (value := struct.unpack_from("<Q", raw, q)[0]):
                name = f"ordinal_{value & 0xFFFF}" if value >> 63 else text((value & 0x7FFFFFFF) + 2)
                imports.append({"slot": base + slots + 8 * k, "name": f"{dll}!{name}"})
                k += 1
            p += 20
    if len(dirs) > 3 and dirs[3][0]:
        p = place(dirs[3][0])
        for k in range(0, dirs[3][1] - 11 if p is not None else 0, 12):
            begin, end, _ = struct.unpack_from("<III", raw, p + k)
            if end > begin:
                boundaries.append({"start": base + begin, "end": base + end})
    if len(dirs) > 5 and dirs[5][0]:
        p, end = place(dirs[5][0]), dirs[5][1]
        done = 0
        while p is not None and done + 8 <= end:
            page, size = struct.unpack_from("<II", raw, p + done)
            if size < 8:
                break
            for k in range(8, size, 2):
                entry_ = struct.unpack_from("<H", raw, p + done + k)[0]
                if entry_ >> 12 == DIR64 and (q := place(page + (entry_ & 0xFFF))) is not None:
                    relocations.append({"slot": base + page + (entry_ & 0xFFF), "target": struct.unpack_from("<Q", raw, q)[0]})
            done += size
    # a slot of the import table stands for itself
    relocations += [{"slot": i["slot"], "target": i["slot"]} for i in imports]
    segments = [{"start": base + rva, "size": size, "file_offset": off, "file_size": held, "executable": bool(flags & SCN_EXECUTE)} for rva, size, off, held, flags in sections]
    return {"entry": base + entry, "segments": segments, "relocations": relocations, "imports": imports, "boundaries": boundaries}


def parse(raw: bytes) -> dict:
    return parse_pe(raw) if raw[:2] == b"MZ" else parse_elf(raw)


_SEGMENT = "array<struct<start:long,size:long,file_offset:long,file_size:long,executable:boolean>>"
_SCHEMA = f"path string, sha256 string, format string, entry long, segments {_SEGMENT}, relocations array<struct<slot:long,target:long>>, imports array<struct<slot:long,name:string>>, boundaries array<struct<start:long,end:long>>"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row an image: path, sha256, format, entry, segments, relocations, imports, boundaries. Addresses are signed 64-bit patterns."""

    def signed(v: int) -> int:
        return v - (1 << 64) if v >> 63 else v

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, sha, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                image = parse(content)
                fixed = {k: [{n: signed(x) if isinstance(x, int) and not isinstance(x, bool) else x for n, x in item.items()} for item in v] for k, v in image.items() if isinstance(v, list)}
                rows.append({"path": p, "sha256": sha, "format": "pe" if content[:2] == b"MZ" else "elf", "entry": signed(image["entry"]), **fixed})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow())

    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInArrow(read, _SCHEMA)


def _arrow() -> pa.Schema:
    seg = pa.struct([("start", pa.int64()), ("size", pa.int64()), ("file_offset", pa.int64()), ("file_size", pa.int64()), ("executable", pa.bool_())])
    pair = lambda a, b, kind=pa.int64(): pa.list_(pa.struct([(a, pa.int64()), (b, kind)]))
    return pa.schema([("path", pa.string()), ("sha256", pa.string()), ("format", pa.string()), ("entry", pa.int64()), ("segments", pa.list_(seg)), ("relocations", pair("slot", "target")), ("imports", pair("slot", "name", pa.string())), ("boundaries", pair("start", "end"))])


def segments(images: DataFrame) -> DataFrame:
    return images.select("path", F.explode("segments").alias("s")).select("path", "s.*")


def read_bytes(extents: DataFrame, found: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds code, the bytes of [address, address + size) from the first segment whose file part covers them, or null.

    extents: address, size; found: segments; contents: path, content. Overlong extents have no bytes.
    """
    placed = discovery.locate(extents, found.where("file_size > 0").withColumnRenamed("size", "memory_size"), "address", "start", "file_size", ["path", "start", "file_offset", "file_size"])
    covered = (F.col("size") > 0) & (F.col("address") + F.col("size") <= F.col("start") + F.col("file_size"))
    at = (F.col("file_offset") + F.col("address") - F.col("start") + 1).cast("int")
    return placed.join(contents.select("path", "content"), "path", "left").withColumn("code", F.when(covered, F.substring("content", at, F.col("size").cast("int")))).drop("content", "path", "start", "file_offset", "file_size")


def boundary_functions(images: DataFrame) -> DataFrame:
    """Functions of an exception table that lie in executable segments."""
    rows = images.select("path", F.explode("boundaries").alias("b")).select("path", F.col("b.start").alias("address"), (F.col("b.end") - F.col("b.start")).alias("size")).where("size > 0")
    code = segments(images).where("executable").select("start", "size")
    return discovery.executable(rows, code, "address").select("address", "size", F.lit("pdata").alias("boundary_source"), F.lit("function").alias("kind"))


def import_functions(images: DataFrame) -> DataFrame:
    """A function of size 0 for each imported name."""
    rows = images.select(F.explode("imports").alias("i"))
    return rows.select(F.col("i.slot").alias("address"), F.lit(0).cast("long").alias("size"), F.col("i.name").alias("name"), F.lit("import-table").alias("boundary_source"), F.lit("import").alias("kind"))


def decode(code: DataFrame) -> DataFrame:
    """Instructions of code (id, address, code) by the capstone library, if it is installed."""
    try:
        import capstone  # noqa: F401
    except ImportError as e:
        raise RuntimeError("decoding needs the capstone library; deliver an instruction table instead") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from capstone import CS_ARCH_X86, CS_MODE_64, Cs

        engine = Cs(CS_ARCH_X86, CS_MODE_64)
        engine.detail = True
        kinds = {1: "register", 2: "immediate", 3: "memory"}
        for batch in batches:
            rows = []
            for i, address, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for x in engine.disasm(raw or b"", address):
                    rows.append({"id": i, "offset": x.address - address, "size": x.size, "mnemonic": x.mnemonic, "operand_text": x.op_str, "operand_kinds": [kinds.get(o.type, "unknown") for o in x.operands], "groups": [x.group_name(g) for g in x.groups]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return code.select("id", "address", "code").mapInArrow(run, "id string, offset int, size int, mnemonic string, operand_text string, operand_kinds array<string>, groups array<string>")
