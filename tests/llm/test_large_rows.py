"""Tables whose rows are MBs: what a reader or a writer holds of them."""

import pyarrow.parquet as pq

from gridlight.llm import alignment
from gridlight.sources.shared import LARGE_ROWS


def test_blocks_lie_in_row_groups_of_a_few(spark):
    docs = spark.range(20).selectExpr("id AS doc_id", "repeat(concat('a ', id, ' b '), 350000) AS text").coalesce(1)  # a block each
    blocks = alignment.blocks_of(docs, alignment.Pair.of())
    groups = [m.row_group(k) for p in blocks.inputFiles() for m in [pq.ParquetFile(p.removeprefix("file://")).metadata] for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 20
    assert max(g.num_rows for g in groups) <= int(LARGE_ROWS["parquet.block.row.count.limit"])  # all 20 before
    assert max(g.total_byte_size for g in groups) < 40e6


def test_groups_of_a_block_beyond_16_bits(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 10**9)
    word = lambda n: "".join(chr(97 + n * 2654435761 % 2**44 // 26**k % 26) for k in range(9))
    docs = spark.createDataFrame([(k, " ".join(map(word, range(500 * k, 500 * k + 500)))) for k in range(1200)], "doc_id long, text string").coalesce(1)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert alignment.blocks_of(docs, alignment.Pair.of()).selectExpr("max(size(groups)) AS n").first().n > 1 << 16
    whole = alignment.align(docs)[0].select(columns).orderBy("doc_id").collect()
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500_000)
    assert alignment.align(docs)[0].select(columns).orderBy("doc_id").collect() == whole
