"""What the kernel's text files say, as Columns: mapped libraries, versions, capabilities, mounts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bits of the capabilities that capture needs, from which kernel on they are told apart, and the first Go release whose calls pass arguments in registers.
CAPABILITIES = {"CAP_BPF": 39, "CAP_PERFMON": 38, "CAP_NET_ADMIN": 12}
OLD_CAPABILITY = ("CAP_SYS_ADMIN", 21)
FINE_GRAINED, REGISTER_ABI = (5, 8), 17
#: Files that hold a TLS library, or are programs that may have one linked in.
TLS_LIBRARY = r"/lib(?:ssl|gnutls|boringssl|conscrypt)[^/]*\.so[^/]*$"


def mapped_files(maps: Column) -> Column:
    """array of (path, base) for the executable mappings of files in a maps text, each path once, with its first base address."""
    rows = F.transform(F.split(maps, "\n"), lambda line: F.split(F.trim(line), r"\s+"))
    good = F.filter(rows, lambda p: (F.size(p) >= 6) & F.get(p, F.lit(1)).contains("x") & F.get(p, F.lit(5)).startswith("/"))
    files = F.transform(good, lambda p: F.struct(F.get(p, F.lit(5)).alias("path"), F.coalesce(F.conv(F.substring_index(F.get(p, F.lit(0)), "-", 1), 16, -10).cast("long"), F.lit(0).cast("long")).alias("base")))
    first = F.filter(files, lambda f, i: F.array_position(F.transform(files, lambda g: g["path"]), f["path"]) == i + 1)
    return F.coalesce(first, F.array().cast("array<struct<path: string, base: bigint>>"))


def go_version(text: Column) -> Column:
    """The first Go version in a program's build information; null for none."""
    return F.nullif(F.regexp_extract(text, r"go1\.[0-9.]+", 0), F.lit(""))


def register_abi(version: Column) -> Column:
    """Whether a Go version passes arguments in registers."""
    return F.coalesce(F.regexp_extract(version, r"^go1\.([0-9]+)(?:\.|$)", 1).try_cast("int"), F.lit(0)) >= REGISTER_ABI


def kernel_version(text: Column) -> Column:
    """struct(major, minor, patch) of the first word that is a version of three parts; null for none."""
    parts = F.regexp_extract_all(text, F.lit(r"(?:^|\s)(\d+\.\d+\.\d*)"), F.lit(1))
    p = F.split(F.get(parts, F.lit(0)), r"\.")
    number = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(F.size(parts) > 0, F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch")))


def effective_capabilities(status: Column) -> Column:
    """The bits of the CapEff line of a status text; null for none."""
    return F.conv(F.nullif(F.regexp_extract(status, r"(?m)^CapEff:\t\s*([0-9a-fA-F]+)\s*$", 1), F.lit("")), 16, -10).cast("long")


def missing_capabilities(version: Column, bits: Column) -> Column:
    """Names of the capabilities that capture needs on this kernel and the bits lack."""
    lacks = lambda bit: F.shiftright(F.coalesce(bits, F.lit(0).cast("long")), bit).bitwiseAND(F.lit(1)) == 0
    fine = F.array_compact(F.array(*[F.when(lacks(bit), F.lit(name)) for name, bit in CAPABILITIES.items()]))
    coarse = F.array_compact(F.array(F.when(lacks(OLD_CAPABILITY[1]), F.lit(OLD_CAPABILITY[0]))))
    major, minor = FINE_GRAINED
    return F.when((version["major"] > major) | ((version["major"] == major) & (version["minor"] >= minor)), fine).otherwise(coarse)


def bpf_mounted(path: Column, mounts: Column) -> Column:
    """Whether a mounts text has a bpf file system at or above the path."""
    rows = F.transform(F.split(mounts, "\n"), lambda line: F.split(F.trim(line), r"\s+"))
    return F.coalesce(F.exists(rows, lambda p: (F.size(p) >= 3) & (F.get(p, F.lit(2)) == "bpf") & path.startswith(F.get(p, F.lit(1)))), F.lit(False))
