"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of one host.

A page is a stream of tokens: tags (name and marking class) and text slots. A slot carries the elements that enclose it,
so slots of different places never match, and with them whether the place belongs to the article (in it, outside menus,
adverts, forms and the like). Adjacent repetitions in a stream become repeated groups, innermost first. The streams of a
host are aligned one after another with the wrapper so far: what only one side has becomes optional, a group on one side
takes in its single occurrence on the other, and strings that differ make their place a text slot, while a string that
TEMPLATE_PAGES different pages or more agree in stays a literal of the template. A page's text is what its stream puts
into the slots of the article that are no literals: a menu without any mark of one is left out because all pages have it.

Distinct streams are few, so they alone are shuffled by host, FAN_IN to a task, and the wrappers of those are aligned
again, level by level. Strings are compared by hashes: of each different page a row of hashes is counted by host and
slot, so a host of any size is spread over all tasks. The wrappers are joined back to the pages by host.

Defined results: a null or empty html gives an empty text; so does a page without text in an article or body; repeated
rows are extracted each by itself, and count as one page for the template; a null url counts as the host ""; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, materialize, worker_cache
from .url_cascade import url_host

#: Streams or wrappers that one task aligns at a time.
FAN_IN = 64
#: Longest repeated group, in items.
LONGEST_GROUP = 12
#: Different pages of a host that must agree in a slot's text before it counts as the template's.
TEMPLATE_PAGES = 5
#: Bytes of wrappers that are sent to all tasks for the join; beyond, both sides are shuffled by host and a salt.
MAX_BROADCAST_BYTES = 32 << 20
TEXT = "T"
# Fixed values of HTML: elements without content of their own, inline elements, elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head title nav footer aside form button select option textarea menu dialog object audio video canvas map".split())
#: An open paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id and role that mark what is not the article.
OTHER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted cookie cookies consent gdpr notice notices alert comment comments reply replies respond disqus discussion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar complementary contentinfo search pagination pager".split())
TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?:[^<]|<(?![a-zA-Z!?/]))+",
    re.S | re.I,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")
#: A layout's class tells what the page has beside the article, not what the element is.
LAYOUT = re.compile(r"^(?:no|has|have|with|without|is|hide|show)[-_]")


def tag_key(tag: str) -> str:
    """``name`` or ``name.`` with its marking words for a start tag, ``/name`` for an end tag, "" for what is left out."""
    known = worker_cache("wrappers")
    found = known.get(tag)
    if found is None:
        m = NAME.match(tag)
        name = m[1].lower() if m else ""
        if not name or name in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "math"):
            found = ""
        elif tag[1] == "/":
            found = "" if name in VOID else "/" + name
        else:
            values = [x for v in MARKS.findall(tag) for x in v.strip("\"'").lower().split() if not LAYOUT.match(x)] if "=" in tag else ()
            words = {w for x in values for w in WORDS.findall(x)} & OTHER_WORDS
            found = ".".join([name, *sorted(words)])
        if len(known) > 50_000:
            known.clear()
        known[tag] = found
    return found


def tokenize(page: str) -> tuple[list[str], list[str]]:
    """Keys of a page's tokens, TEXT for text, and the texts ("" for tags)."""
    keys, texts = [], []
    for m in TOKENS.finditer(page):
        token = m[0]
        if token[0] != "<" or len(token) > 1 and token[1] not in "!?/" and not token[1].isalpha() or token == "<":
            keys.append(TEXT)
            texts.append(token)
        elif token[1] not in "!?" and (key := tag_key(token)):
            keys.append(key)
            texts.append("")
    return keys, texts


def is_text(key: object) -> bool:
    return isinstance(key, str) and key[0] == TEXT


def root_of(keys: list[str]) -> str:
    """Where a page's text is to be found: in articles, else in main, else in the body."""
    names = {k for k in keys if k in ("article", "main")}
    return "article" if "article" in names else "main" if "main" in names else "body"


def placed(keys: list[str], root: str) -> list[str]:
    """The keys with each text slot's place: TEXT, "1" in the article or "0", and a hash of the enclosing elements."""
    out, stack, inside, bad = [], [], 0, 0  # stack: (name, is root, is bad, hash of the path)
    path = 0
    for key in keys:
        if key == TEXT:
            good = not bad and (inside or root == "body")
            out.append(f"{TEXT}{int(good)}{path:08x}")
            continue
        out.append(key)
        if key[0] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == key[1:]:
                    for _, was_root, was_bad, _ in stack[i:]:
                        inside -= was_root
                        bad -= was_bad
                    del stack[i:]
                    path = stack[-1][3] if stack else 0
                    break
            continue
        name, _, words = key.partition(".")
        if name in ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
            path = stack[-1][3] if stack else 0
        if name not in VOID:
            outside = name == "header" and not inside
            # The page's own frame may carry any class.
            is_bad = name in HIDDEN or outside or bool(words) and name not in ("html", "body")
            if name not in INLINE or words:
                path = zlib.crc32(key.encode(), path)
            stack.append((name, name == root, is_bad, path))
            inside += name == root
            bad += is_bad
    return out


Item = tuple  # (key, leaves): key a string or ("+", keys...), leaves the token places for each leaf of the key


def collapse(keys: list[str], texts: list[str]) -> list[Item]:
    """Items of a stream with repeated groups, innermost first. Blank texts are no slots."""
    # Inline markup does not change what a slot is: it takes part in no group, so texts beside it are one slot.
    items: list[Item] = []
    for i, key in enumerate(keys):
        if key[0] == TEXT:
            if texts[i].strip():
                if items and items[-1][0] == key:
                    items[-1][1][0].append(i)
                else:
                    items.append((key, [[i]]))
        elif "." in key or key.lstrip("/") not in INLINE:
            items.append((key, [[i]]))
    changed = True
    while changed:
        changed = False
        for size in range(1, LONGEST_GROUP + 1):
            names = [x[0] for x in items]
            if len(names) < 2 * size:
                break
            out, i = [], 0
            while i < len(items):
                first = names[i : i + size]
                if is_text(first[0]) or first[0][0] == "/" or names[i + size : i + 2 * size] != first or len(names) < i + 2 * size or size == 1 and first[0][0] == "+":
                    out.append(items[i])
                    i += 1
                    continue
                leaves = [list(leaf) for x in items[i : i + size] for leaf in x[1]]
                i += size
                while names[i : i + size] == first:
                    for mine, more in zip(leaves, (leaf for x in items[i : i + size] for leaf in x[1]), strict=True):
                        mine.extend(more)
                    i += size
                out.append((("+", *first), leaves))
                changed = True
            items = out
    return items


def take_in(names: list, groups: Iterable[tuple]) -> list[tuple[object, int]]:
    """(name, how many items it covers): single occurrences of another side's groups stand as those groups."""
    known = sorted(set(groups), key=lambda g: (-len(g), str(g)))
    out, i = [], 0
    while i < len(names):
        for g in known:
            if tuple(names[i : i + len(g) - 1]) == g[1:]:
                out.append((g, len(g) - 1))
                i += len(g) - 1
                break
        else:
            out.append((names[i], 1))
            i += 1
    return out


def groups_of(names: Iterable) -> list[tuple]:
    return [n for n in names if isinstance(n, tuple)]


def align(wrapper: list[tuple], other: list[tuple]) -> list[tuple]:
    """The wrapper (name, optional) that takes in another one too; a stream is a wrapper without options."""

    def taken(side: list[tuple], groups: list[tuple]) -> tuple[list, list[bool]]:
        covered = take_in([n for n, _ in side], groups)
        flags, at = [], 0
        for _, covers in covered:
            flags.append(any(o for _, o in side[at : at + covers]))
            at += covers
        return [n for n, _ in covered], flags

    own, own_optional = taken(wrapper, groups_of(n for n, _ in other))
    new, new_optional = taken(other, groups_of(n for n, _ in wrapper))
    out: list[tuple] = []
    for kind, a, b, c, d in SequenceMatcher(None, own, new, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [(own[i], own_optional[i] or new_optional[c + i - a]) for i in range(a, b)]
        else:
            out += [(own[i], True) for i in range(a, b)] + [(n, True) for n in new[c:d]]
    return out


def infer(wrappers: Iterable[list[tuple]]) -> list[tuple]:
    whole: list[tuple] | None = None
    for other in wrappers:
        whole = other if whole is None else align(whole, other)
    return whole or []


def flat(name: object) -> list[str]:
    return [x for part in name[1:] for x in flat(part)] if isinstance(name, tuple) else [name]


def frozen(x: object) -> object:
    return tuple(map(frozen, x)) if isinstance(x, list) else x


def as_wrapper(stored: str) -> list[tuple]:
    return [(frozen(n), bool(o)) for n, o in json.loads(stored)]


class Wrapper:
    """A host's wrapper, ready to place the leaves of streams; ``literals``: leaves whose text is the template's."""

    def __init__(self, stored: str, literals: Iterable[int] = ()):
        self.names = [n for n, _ in as_wrapper(stored)]
        self.first_leaf, at = [], 0
        for n in self.names:
            self.first_leaf.append(at)
            at += len(flat(n))
        self.literals = frozenset(literals)
        self.seen: dict[tuple, list[int]] = {}

    def leaves(self, names: tuple) -> list[int]:
        """For each leaf of a stream the wrapper's leaf, -1 where it has none; kept for streams seen before."""
        if names not in self.seen:
            if len(self.seen) > 2000:
                self.seen.clear()
            self.seen[names] = self._leaves(list(names))
        return self.seen[names]

    def _leaves(self, names: list) -> list[int]:
        taken = take_in(names, groups_of(self.names))
        sizes = [len(flat(n)) for n in names]
        first, covered, at = [], [], 0
        for _, covers in taken:
            first.append(sum(sizes[:at]))
            covered.append(sum(sizes[at : at + covers]))
            at += covers
        out = [-1] * sum(sizes)
        for a, b, size in SequenceMatcher(None, self.names, [n for n, _ in taken], autojunk=False).get_matching_blocks():
            for i in range(size):
                for j in range(covered[b + i]):
                    out[first[b + i] + j] = self.first_leaf[a + i] + j
        return out


def blocks_text(keys: list[str], texts: list[str], main: set[int]) -> str:
    """Blocks in page order, white space folded; inline elements do not end a block."""
    out, block = [], []
    for i, key in enumerate(keys):
        if key[0] == TEXT:
            block.append(texts[i] if i in main or not texts[i].strip() else "")
        elif key.lstrip("/").partition(".")[0] not in INLINE and block:
            out.append("".join(block))
            block = []
    out.append("".join(block))
    return " ".join(x for b in out if (x := " ".join(entities.unescape(b).split())))


def parsed(page: str | None) -> tuple[str, list[str], list[str], list[Item]]:
    keys, texts = tokenize(page or "")
    root = root_of(keys)
    keys = placed(keys, root)
    return root, keys, texts, collapse(keys, texts)


def extract(page: str | None, wrappers: dict[str, Wrapper] | None = None) -> str:
    """A page's text: its slots in the article, but for literals of its host's wrapper for its kind of root."""
    root, keys, texts, items = parsed(page)
    main = {i for name, leaves in items for key, leaf in zip(flat(name), leaves, strict=True) if key[:2] == TEXT + "1" for i in leaf}
    wrapper = (wrappers or {}).get(root)
    if wrapper and wrapper.literals and main:
        at = wrapper.leaves(tuple(n for n, _ in items))
        for leaf, place in zip((leaf for _, leaves in items for leaf in leaves), at, strict=True):
            if place in wrapper.literals:
                main.difference_update(leaf)
    return blocks_text(keys, texts, main)


STREAM = "host string, root string, names string, stream long, page long, slots array<int>, hashes array<bigint>"


def page_streams(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Of each page its host, root, stream with a hash of it, a hash of all its article texts, and the hash of each slot's."""
    base = pages.select(url_host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    hashed = lambda t: xxhash.xxh64_intdigest(t) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                root, _, texts, items = parsed(page.as_py())
                names = json.dumps([[n, 0] for n, _ in items], separators=(",", ":"))
                slots = [(n, "\n".join(texts[i] for i in leaf)) for n, (key, leaf) in enumerate((k, leaf) for name, leaves in items for k, leaf in zip(flat(name), leaves, strict=True)) if key[:2] == TEXT + "1"]
                rows.append((host, root, names, hashed(names), hashed("\0".join(t for _, t in slots)), [n for n, _ in slots], [hashed(" ".join(t.split())) for _, t in slots]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "root", "names", "stream", "page", "slots", "hashes"])

    return base.mapInArrow(run, STREAM)


def aligned(parts: DataFrame) -> DataFrame:
    """One wrapper for each (host, root, part) of (host, root, part, wrapper)."""

    def one(t: pa.Table) -> pa.Table:
        # Long streams first: they show most of the groups.
        order = sorted(t["wrapper"].to_pylist(), key=lambda s: (-len(s), s))
        return pa.table({"host": t["host"].slice(0, 1), "root": t["root"].slice(0, 1), "wrapper": pa.array([json.dumps(infer(map(as_wrapper, order)), separators=(",", ":"))], pa.string())})

    return parts.groupBy("host", "root", "part").applyInArrow(one, "host string, root string, wrapper string")


def infer_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, root, wrapper, literals): the wrapper as JSON of names and options, and the leaves whose text is the template's."""
    rows = materialize(page_streams(pages, url_col, html_col), "streams")
    # One row for each stream, then one for each part of FAN_IN streams, until each host and root has one wrapper.
    wrappers = materialize(rows.groupBy("host", "root", "stream").agg(F.first("names").alias("wrapper")), "wrappers")
    streams = wrappers.withColumnRenamed("wrapper", "names")
    most = 2
    while most > 1:
        counts = wrappers.groupBy("host", "root").agg(F.ceil(F.count("*") / FAN_IN).alias("parts"))
        parts = wrappers.join(counts, ["host", "root"]).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("parts")))
        wrappers = materialize(aligned(parts), "wrappers")
        most = wrappers.groupBy("host", "root").count().agg(F.max("count")).first()[0] or 0
    # Each different page counts once; its slots are the wrapper's leaves by its stream.
    places = joined_by_host(streams, wrappers, ["host", "root"], F.xxhash64("stream"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Wrapper] = {}
        for b in batches:
            out = []
            for stored, names in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if stored not in kept:
                    kept.clear()
                    kept[stored] = Wrapper(stored)
                out.append(kept[stored].leaves(tuple(n for n, _ in as_wrapper(names))))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=["host", "root", "stream", "leaves"])

    placed_streams = places.select("host", "root", "stream", "wrapper", "names").mapInArrow(leaves, "host string, root string, stream long, leaves array<int>")
    distinct = rows.select("host", "root", "page", "stream", "slots", "hashes").dropDuplicates(["host", "root", "page"])
    slots = distinct.select("host", "root", "stream", F.explode(F.arrays_zip("slots", "hashes")).alias("s")).groupBy("host", "root", "stream", F.col("s.slots").alias("slot")).agg(F.min("s.hashes").alias("low"), F.max("s.hashes").alias("high"), F.count("*").alias("n"))
    by_leaf = slots.join(placed_streams, ["host", "root", "stream"]).withColumn("leaf", F.get("leaves", F.col("slot"))).filter("leaf >= 0")
    counted = by_leaf.groupBy("host", "root", "leaf").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    literals = counted.filter((F.col("low") == F.col("high")) & (F.col("n") >= TEMPLATE_PAGES)).groupBy("host", "root").agg(F.array_sort(F.collect_list("leaf")).alias("literals"))
    # A host whose pages agree in everything shows no template: one slot at least must differ.
    varied = counted.filter("low <> high").select("host", "root").distinct()
    literals = literals.join(varied, ["host", "root"], "left_semi")
    return wrappers.join(literals, ["host", "root"], "left").select("host", "root", "wrapper", F.coalesce("literals", F.array().cast("array<int>")).alias("literals"))


def joined_by_host(rows: DataFrame, small: DataFrame, keys: list[str], spread_by) -> DataFrame:
    """A left join with one row for each key, sent to all tasks while its bytes are few, else with salted keys."""
    size = small.agg(F.sum(F.length(F.to_json(F.struct(*small.columns))))).first()[0] or 0
    if size <= MAX_BROADCAST_BYTES:
        return rows.join(F.broadcast(small), keys, "left")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(spread_by, F.lit(SALTS)).cast("int")).join(copies, [*keys, "__salt"], "left").drop("__salt")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page by its host's wrapper."""
    found = infer_wrappers(pages, url_col=url_col, html_col=html_col).filter(F.size("literals") > 0)
    wrappers = materialize(found.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("root", F.struct("wrapper", "literals"))))).alias("roots")), "wrappers")
    base = pages.select(F.col(id_col), F.col(url_col), F.coalesce(F.col(html_col), F.lit("")).alias("__html"), url_host(F.col(url_col)).alias("host"))
    joined = joined_by_host(base, wrappers, ["host"], F.xxhash64("__html")).select(id_col, url_col, "__html", "roots")
    kind = base.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, Wrapper]] = {}
        for b in batches:
            out = []
            for page, stored in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if stored is not None and stored not in kept:
                    if len(kept) > 500:
                        kept.clear()
                    kept[stored] = {root: Wrapper(w["wrapper"], w["literals"]) for root, w in json.loads(stored).items()}
                out.append(extract(page.as_py(), kept.get(stored)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=[id_col, url_col, "text"])

    texts = joined.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
