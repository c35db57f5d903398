"""What a Python worker holds at once."""

import numpy as np
import pandas as pd

from articleflow.sources.readerviews import ReaderViews


def test_wide_rows_come_in_small_batches(spark):
    ReaderViews(spark, "/root/testdata/sf0.001")
    pages = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 4000) AS html")

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"held": [int(batch["html"].str.len().sum())]})

    held = [r["held"] for r in pages.mapInPandas(sizes, "held long").collect()]
    assert sum(held) == 16_000_000 and max(held) < 3_000_000


def test_vectors_are_dealt_to_cells_in_small_parts(spark):
    from articleflow.operators.similar import DEAL_ROWS, _parts

    batch = pd.DataFrame({"group_id": np.arange(1000)})
    parts = list(_parts(iter([batch, batch.iloc[:0], batch.iloc[:1]])))
    assert pd.concat(parts)["group_id"].tolist() == [*range(1000), 0]
    assert max(map(len, parts)) == DEAL_ROWS


def test_tiles_of_crowded_cells_grow_and_every_pair_meets_once(spark):
    from articleflow.operators.similar import _tiles

    cells = spark.range(400).selectExpr("1L AS cell", "id < 100 AS resident", "id AS group_id", "array(1D) AS embedding")
    tiles = _tiles(cells, 10).drop("embedding").cache()
    # Eight column blocks for residents, two row blocks for all.
    assert tiles.count() == 100 * 8 + 400 * 2
    left, right = tiles.where("side = 0").alias("l"), tiles.where("side = 1").alias("r")
    met = left.join(right, ["cell", "a", "b"]).select("l.group_id", "r.group_id")
    assert met.count() == met.distinct().count() == 100 * 400
