"""``spark.read.format("pairloom")``: tiles of scenes, a partition for each tile of each scene.

Options: path (one or more, by commas), tile_size, overlap, bands (1-based, by commas), and what a reader takes (dataset,
variable, band). Filters on tile_index, row_off and col_off are pushed down to the list of partitions, so a sampled scan opens
the sampled windows only. A window that can't be read gives a row with read_error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from pairloom.operators.tiles import TILES


class Tile(InputPartition):
    def __init__(self, path: str, index: int, row: int, col: int, height: int, width: int) -> None:
        self.path, self.index, self.row, self.col, self.height, self.width = path, index, row, col, height, width


class TileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.size, self.overlap = int(options.get("tile_size", 1024)), int(options.get("overlap", 0))
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.more = {k: options[k] for k in ("dataset", "variable", "band") if k in options}
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        compare = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            test = compare.get(type(f))
            if test and f.attribute in (("tile_index",), ("row_off",), ("col_off",)):
                self.tests.append((f.attribute[0], test, f.value))
            else:
                yield f

    def partitions(self) -> list[Tile]:
        from pairloom.sources.readers import open_image

        out = []
        for path in self.paths:
            m = open_image(path, **self.more).metadata
            across, down, s, o = -(-m.width // self.size), -(-m.height // self.size), self.size, self.overlap
            for k in range(across * down):
                i, j = divmod(k, across)
                r, c = max(i * s - o, 0), max(j * s - o, 0)
                t = {"tile_index": k, "row_off": r, "col_off": c}
                if all(test(t[a], v) for a, test, v in self.tests):
                    out.append(Tile(path, k, r, c, min((i + 1) * s + o, m.height) - r, min((j + 1) * s + o, m.width) - c))
        return out

    def read(self, tile: Tile) -> Iterator[tuple]:
        from pairloom.errors import PairloomError
        from pairloom.sources.readers import open_image

        bands = self.bands or [1]
        try:
            reader = open_image(tile.path, **self.more)
            bands = self.bands or list(range(1, reader.metadata.band_count + 1))
            data = reader.read(bands, (tile.row, tile.col, tile.height, tile.width))
        except (PairloomError, OSError, ValueError, IndexError) as e:
            for b in bands:
                yield tile.path, b, tile.index, tile.row, tile.col, tile.height, tile.width, None, None, str(e)
            return
        for b, plane in zip(bands, data):
            yield tile.path, b, tile.index, tile.row, tile.col, tile.height, tile.width, plane.dtype.name, plane.tobytes(), None


class SceneSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pairloom"

    def schema(self) -> str:
        return TILES

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(dict(self.options))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SceneSource)
