"""Benchmark passages in a corpus, through a positional inverted index of the corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroudline.llm.work import body, fresh, settle, sliced

# Words are made of digits, letters and all bytes beyond ASCII; A-Z are lower-cased, any other byte becomes a space.
TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))

# Terms, and windows, that may be sent to every task; beyond this the same steps join by shuffle instead.
MOST_TERMS = 1_000_000
MOST_WINDOWS = 100_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows_of(benchmark: DataFrame, width: int, item_id: str, text: str) -> DataFrame:
    """(item_id, window): every ``width`` consecutive words of an item, all its words if fewer, nothing if none."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item_id"), body(text).alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, item in enumerate(batch.column("body").to_pylist()):
                words = words_of(item)
                found = {b" ".join(words[j : j + width]).decode() for j in range(max(1, len(words) - width + 1))} - {""}
                at.extend([i] * len(found))
                out.extend(found)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], ["item_id", "window"])

    return rows.mapInArrow(run, "item_id string, window string").filter("item_id is not null").distinct()


def term_counts(docs: DataFrame, terms: Broadcast | None) -> DataFrame:
    """(term, n): occurrences in the corpus, of the given terms only if there are some; counted per batch, then added."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if terms is None else terms.value.__contains__
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("body").to_pylist():
                words = words_of(text)
                counts.update(words if wanted is None else filter(wanted, words))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return docs.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


POSTINGS = "array<struct<term:string,pos:int,left:string,right:string>>"


def index(docs: DataFrame, reach: Broadcast | None, width: int) -> DataFrame:
    """(row, doc_id, n_words, postings): where each term stands, with up to ``width`` words on either side.

    ``reach`` limits the index to terms and says how many words a posting needs on each side; None takes all.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32()), ("left", pa.string()), ("right", pa.string())]))
        wanted = None if reach is None else reach.value
        for batch in sliced(batches):
            sizes, postings = [], []
            for text in batch.column("body").to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                found = range(len(words)) if wanted is None else () if wanted.keys().isdisjoint(words) else [i for i, w in enumerate(words) if w in wanted]
                row = []
                for i in found:
                    before, after = (width - 1, width) if wanted is None else wanted[words[i]]
                    left, right = b" ".join(words[max(0, i - before) : i]).decode(), b" ".join(words[i : i + after]).decode()
                    row.append({"term": words[i].decode(), "pos": i, "left": f" {left} " if left else " ", "right": f"{right} " if right else ""})
                postings.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(postings, shape)], ["row", "doc_id", "n_words", "postings"])

    return docs.select("row", "doc_id", "body").mapInArrow(run, f"row long, doc_id {kind}, n_words long, postings {POSTINGS}")


def placed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(number, window, term, second, ...): each window with its rarest term, the next rarest, and where they stand in it."""
    parts = windows.select("number", "window", F.split("window", " ").alias("w"))
    each = parts.select("number", F.posexplode("w").alias("at", "term")).join(counts, "term", "left")
    ranked = each.groupBy("number", "term").agg(F.min("at").alias("at"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    lists = ranked.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("n", "term", "at"))).alias("r"))  # at most ``width`` terms
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    return parts.join(lists, "number").select(
        "number", "window", F.size("w").alias("size"), first["term"].alias("term"), first["at"].alias("at"), first["n"].alias("n"),
        second["term"].alias("second"), second["at"].alias("second_at"),
        F.concat(F.lit(" "), F.array_join(F.transform(F.slice("w", F.lit(1), first["at"]), lambda w: F.concat(w, F.lit(" "))), "")).alias("head"),
        F.array_join(F.transform(F.slice("w", first["at"] + 1, F.lit(1 << 20)), lambda w: F.concat(w, F.lit(" "))), "").alias("tail"),
    )


class Matches:
    """Phrase and proximity matches of benchmark windows in ``docs``, and what they are found with.

    Windows and terms of the benchmark are counted first.  Up to MOST_TERMS and MOST_WINDOWS they are sent to every
    task; a larger benchmark is joined by shuffle, with the same result.  The corpus is read twice: to count the
    benchmark's terms over all documents, and to store postings of the rarest terms of each window.  Postings are exploded
    only against windows of their own term, and a window matches where the words on both sides of the posting are its words.

    ``proximity`` adds postings of the next rarest terms, which only :meth:`proximities` needs.

    Null text has no words.  Rows are told apart by a row number, so null and repeated ids are rows like any other.
    Items without words or id have no windows.  Either table may be empty.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, width: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", proximity: bool = False) -> None:
        spark, self.width = docs.sparkSession, width
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), body(text).alias("body"))
        self.items = settle(windows_of(benchmark, width, item_id, item_text), "windows")
        windows = settle(self.items.select("window").distinct().select(F.monotonically_increasing_id().alias("number"), "window"), "numbered")
        self.windows = windows
        terms = windows.select(F.explode(F.split("window", " ")).alias("term")).distinct()
        small = terms.count() <= MOST_TERMS
        sent = spark.sparkContext.broadcast(frozenset(r[0].encode() for r in terms.collect())) if small else None
        counts = settle(term_counts(rows.select("body"), sent).join(terms, "term", "left_semi"), "terms")
        # what never occurs in the corpus has no match
        self.anchors = settle(placed(windows, counts).filter("n > 0"), "anchors")
        reach = None
        if small:
            first = self.anchors.select("term", F.col("at").alias("before"), (F.col("size") - F.col("at")).alias("after"))
            second = self.anchors.filter("second is not null" if proximity else "false").select(F.col("second").alias("term"), F.lit(0).alias("before"), F.lit(0).alias("after"))
            needs = first.unionByName(second).groupBy("term").agg(F.max("before").alias("before"), F.max("after").alias("after"))
            reach = spark.sparkContext.broadcast({r["term"].encode(): (r["before"], r["after"]) for r in needs.collect()})
        self.index = settle(index(rows, reach, width), "index")
        self.sent = self.anchors.count() <= MOST_WINDOWS

    def postings(self) -> DataFrame:
        return self.index.filter(F.size("postings") > 0).select("row", F.inline("postings"))

    def _windows(self, *columns: str) -> DataFrame:
        chosen = self.anchors.select(*columns)
        return F.broadcast(chosen) if self.sent else chosen

    def phrases(self) -> DataFrame:
        """(row, number, start, end): word positions of exact occurrences of windows."""
        found = self.postings().join(self._windows("number", "term", "at", "size", "head", "tail"), "term")
        found = found.filter(F.col("right").startswith(F.col("tail")) & F.col("left").endswith(F.col("head")))
        start = F.col("pos") - F.col("at")
        return found.select("row", "number", start.alias("start"), (start + F.col("size")).alias("end")).distinct()

    def proximities(self, slack: int = 5) -> DataFrame:
        """(row, number, start): the two rarest terms of a window stand apart as in the window, give or take ``slack`` words.

        The lists of both terms are moved by their place in the window and cut into bins of ``slack``, so only
        postings that can lie close meet.
        """
        def moved(term: str, at: str) -> DataFrame:
            mine = self._windows("number", F.col(term).alias("term"), F.col(at).alias("place")).filter("term is not null")
            return self.postings().select("row", "term", "pos").join(mine, "term").select("row", "number", (F.col("pos") - F.col("place")).alias("start"))

        size = slack + 1
        one = moved("term", "at").withColumn("bin", F.explode(F.array(*(F.floor(F.col("start") / size) + d for d in (-1, 0, 1)))))
        two = moved("second", "second_at").select("row", "number", F.col("start").alias("other"), F.floor(F.col("start") / size).alias("bin"))
        return one.join(two, ["row", "number", "bin"]).filter(F.abs(F.col("start") - F.col("other")) <= slack).select("row", "number", "start").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **names) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (sorted list of item ids), contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated if at least one in ``share`` words is.

    Null or empty text has no words and is not contaminated.  Rows without id, and rows that share one, are judged each by their own text.  A
    benchmark item without id cannot be named and is left out; items with equal texts are all named.  An empty benchmark hits nothing, an
    empty table gives an empty result.  Texts of any length are read whole; a posting holds a few words around it and never the text.
    """
    found = Matches(docs, benchmark, **names)
    phrases = settle(found.phrases(), "phrases")
    order = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.col("start"), F.coalesce(F.max("end").over(order), F.lit(0)))
    hits = phrases.withColumn("new", F.greatest(F.lit(0), F.col("end") - before)).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    numbered = found.items.join(found.windows, "window").select("item_id", "number")
    items = phrases.select("row", "number").distinct().join(numbered, "number").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = found.index.select("row", "doc_id", "n_words").join(hits, "row", "left").join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **names) -> DataFrame:
    """``docs`` without the contaminated ones.  Each row goes by its own text, also without id or with an id that others have."""
    (number,) = fresh(docs, "number")
    rows = settle(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
    gone = find_contamination(rows, benchmark, doc_id=number, **names).filter("contaminated").select(F.col("doc_id").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)
