"""Secret scans by corpus-wide ownership frequency.

Every text is scanned once for candidates: the base kinds and further ones of
this method. Each candidate's value is hashed, and the corpus is aggregated by
hash: in how many distinct repositories and by how many distinct owners does it
stand? Near copies of a text count as one repository. A value that many owners or
many repositories have is a copied example; one that few of both have is
owner-specific and live-looking. Base spans always stay; spans of the further
kinds are added where their value is live-looking.

Null text has no spans; repeated rows keep one result row each (each text is a
repository of its own unless ``repo_col`` says otherwise); null owners count as
one owner; rows without an id are scanned and counted like others; very long texts
are scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, map_texts, stored
from .near_dups import near_duplicates

#: The base kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Public forms of further credentials.
FURTHER = {
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "signed": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "key": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    "bearer": re.compile(r"[Bb]earer ([A-Za-z0-9+/_.=-]{16,})"),
    "random": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_-])"),
}
KINDS = ("assign", "access", "hex", *FURTHER)
BASE = 3
#: Bits per character from which a run of characters counts as random.
RANDOM_BITS = 3.5


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value), by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def further_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of the further kinds that no base span overlaps."""
    found: list[tuple[int, int, int, str]] = []
    held = disjoint((a, b) for _, a, b, _ in taken)
    for i, (kind, pattern) in enumerate(FURTHER.items(), BASE):
        fresh = []
        starts = [a for a, _ in held]
        for m in pattern.finditer(text):
            value = m[pattern.groups]
            a, b = m.span()
            if kind == "random" and bits(value) < RANDOM_BITS:
                continue
            at = bisect.bisect_left(starts, b) - 1  # the last held span that begins before b
            if at < 0 or held[at][1] <= a:
                fresh.append((i, a, b, value))
        if fresh:
            found += fresh
            held = disjoint([*held, *((a, b) for _, a, b, _ in fresh)])
    return found


def disjoint(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, sorted."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans)


def scan(texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
    for text in texts:
        base = base_spans(text)
        for k, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(sum(x[0] == k for x in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        every = sorted(base + further_spans(text, base), key=lambda x: (x[1], x[0]))
        out["found"].append([{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).digest()[:12]} for k, a, b, v in every])
    return out


#: A value with this share of all uses is looked up in a broadcast of at most so many values.
WIDE_SHARE = 1000


def with_usage(each: DataFrame, usage: DataFrame) -> DataFrame:
    """``each`` use with the counts of its value; the values that hold a thousandth of all uses or more are broadcast, not dealt."""
    total = usage.agg(F.coalesce(F.sum("n_uses"), F.lit(0))).first()[0]
    often = F.col("n_uses") * WIDE_SHARE >= total
    hot, rest = F.broadcast(usage.filter(often)), usage.filter(~often)
    return each.join(hot, "hash").unionByName(each.join(hot.select("hash"), "hash", "left_anti").join(rest, "hash"))


def with_copies_once(scanned: DataFrame, each: DataFrame, usage: DataFrame, max_owners: int, max_repos: int, made: list[str]) -> DataFrame:
    """``usage`` with near copies of a text as one repository.

    Only the texts whose values few owners but many repositories have are compared;
    no other verdict depends on it.
    """
    wide = stored(usage.filter((F.col("n_owners") <= max_owners) & (F.col("n_repos") > max_repos)).select("hash"), "wide", made)
    if wide.isEmpty():
        return usage
    uses = each.join(wide, "hash").select("hash", "text_key").distinct()
    keys = uses.select("text_key").distinct()
    texts = scanned.filter("text is not null").select("text_key", "text").join(keys, "text_key").dropDuplicates(["text_key"])
    groups = near_duplicates(stored(texts.select(F.col("text_key").alias("doc_id"), "text"), "texts", made))
    of_text = groups.select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("of"))
    n_texts = uses.join(of_text, "text_key").select("hash", "of").distinct().groupBy("hash").agg(F.count("*").alias("n_texts"))
    once = usage.join(n_texts, "hash", "left")
    return once.select("hash", "n_owners", F.least("n_repos", "n_texts").alias("n_repos"), "n_uses")


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    max_owners: int = 2,
    max_repos: int = 2,
) -> DataFrame:
    """Counts, digests and spans of every row, and which are live-looking.

    A value is live-looking with at most ``max_owners`` distinct owners and
    ``max_repos`` distinct repositories. Columns:
    doc_id, n_assign, n_access, n_hex, base_sha256, spans (string), n_live,
    n_examples, text_key (xxhash64 of the text), marks (array of kind, start, end,
    n_owners, n_repos, live).
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.col(owner_col)).alias("owner"),
        (F.xxhash64(F.col(repo_col)) if repo_col else F.lit(None).cast("long")).alias("repo"),
    ).withColumn("text_key", F.xxhash64("text"))
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:long,end:long,hash:binary>>"
    scanned = map_texts(rows, scan, schema, keep=("doc_id", "owner", "repo", "text_key", "text"))
    scanned = scanned.withColumn("row", F.monotonically_increasing_id()).withColumn("text", F.when(F.size("found") > 0, F.col("text")))
    made: list[str] = []
    scanned = stored(scanned, "secrets", made)
    each = scanned.select("row", "owner", F.coalesce("repo", "text_key").alias("repo"), "text_key", F.explode("found").alias("f")).select("row", "owner", "repo", "text_key", "f.*")
    counted = lambda rows, c, n: rows.select("hash", c).distinct().groupBy("hash").agg(F.count("*").alias(n))
    usage = counted(each, "owner", "n_owners").join(counted(each, "repo", "n_repos"), "hash").join(each.groupBy("hash").agg(F.count("*").alias("n_uses")), "hash")
    usage = stored(with_copies_once(scanned, each, usage, max_owners, max_repos, made), "usage", made)
    marks = (
        with_usage(each, usage)
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos"))).alias("marks"))
    )
    live = lambda m: (m["n_owners"] <= max_owners) & (m["n_repos"] <= max_repos)
    name = F.array(*map(F.lit, KINDS))
    text_of = lambda m: F.concat_ws(":", F.get(name, m["kind"]), m["start"], m["end"])
    stays = lambda m: (m["kind"] < BASE) | live(m)
    kept = F.coalesce(F.filter("marks", stays), F.array())
    full = F.transform(
        F.coalesce("marks", F.array()),
        lambda m: F.struct(F.get(name, m["kind"]).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["n_owners"].alias("n_owners"), m["n_repos"].alias("n_repos"), live(m).alias("live")),
    )
    count = lambda test: F.size(F.filter(F.coalesce("marks", F.array()), test)).cast("long")
    out = scanned.join(marks, "row", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.concat_ws(",", F.transform(kept, text_of)).alias("spans"),
        count(live).alias("n_live"),
        count(lambda m: ~live(m)).alias("n_examples"),
        "text_key",
        full.alias("marks"),
    )
    out = stored(out, "secret_spans")
    drop_tables(docs.sparkSession, made)
    return out


def redacted(text: Column, marks: Column, cover: str = "[secret]") -> Column:
    """``text`` with its live-looking spans covered, from the last to the first; overlapping spans count once."""
    spans = F.reverse(F.filter(F.coalesce(marks, F.array()), lambda m: m["live"]))
    start = F.struct(text.alias("text"), F.length(text).cast("long").alias("bound"))

    def cut(state: Column, m: Column) -> Column:
        whole = state["text"]
        end = F.least(m["end"], state["bound"])
        head = F.substring(whole, F.lit(1), m["start"].cast("int"))
        tail = F.substring(whole, (end + 1).cast("int"), F.length(whole))
        covered = F.concat(head, F.lit(cover), tail)
        joined = F.concat(head, F.substring(whole, (state["bound"] + 1).cast("int"), F.length(whole)))
        return F.struct(F.when(m["end"] > state["bound"], joined).otherwise(covered).alias("text"), m["start"].alias("bound"))

    return F.aggregate(spans, start, cut, lambda s: s["text"])
