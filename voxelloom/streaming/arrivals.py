"""Filter image files, and answer requests, as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxelloom.operators.filters import apply_filter
from voxelloom.operators.roi import parse_requests, roi_assemble, roi_blur
from voxelloom.schema import TILES
from voxelloom.session import reliable_checkpoint
from voxelloom.sources import images, tables
from voxelloom.sources.pixlog import PixLog


def arriving_tiles(
    spark: SparkSession,
    source: str,
    image_id: int = -1,
    files_per_trigger: int = 1000,
    on_error: str = "skip",
    color: str = "reject",
) -> DataFrame:
    """A stream of the usable tiles among the image files that appear in a folder."""
    reader = spark.readStream.format("image").schema(images.IMAGE_ROWS)
    reader = reader.option("dropInvalid", "false").option("maxFilesPerTrigger", files_per_trigger)
    decoded = images.decode_tiles(reader.load(source), image_id, color)
    return images.usable(decoded, on_error).select(*TILES.fieldNames())


def filter_arrivals(
    arriving: DataFrame,
    target: str,
    checkpoint: str,
    filter_name: str,
    params: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Filter a stream of tiles and append the results to the tile table, a log of batches, until no file is left.

    A batch that is repeated after a failure adds nothing twice; only tiles that are not stored yet are filtered.
    """

    def store(batch: DataFrame, number: int) -> None:
        PixLog(batch.sparkSession, target).append(f"{checkpoint}#{number}", batch, lambda fresh: apply_filter(fresh, filter_name, params))

    writer = arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def answer_arrivals(
    spark: SparkSession,
    source: str,
    pix: str,
    target: str,
    checkpoint: str,
    sigmas: tuple[float, float, float] | None = None,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Cut the boxes that request files ask for, as the files appear, out of the tile table, until no file is left.

    With ``sigmas`` each box is blurred as one piece. Answers go to a log of batches: a batch that is repeated after a failure
    adds nothing twice, and a box that was answered before is not stored again. Lines that are no requests are passed
    over. Every batch sees the tile table as it is then, and reads only regions that it needs where the table has them.
    """

    def answer(batch: DataFrame, number: int) -> None:
        session, name = batch.sparkSession, f"{checkpoint}#{number}"
        log = PixLog(session, target)
        if name in log.committed():
            return
        asked = reliable_checkpoint(parse_requests(batch).where("valid").drop("valid"))
        tiles = tables.read_for(session, pix, asked)
        boxes = roi_blur(tiles, asked, *sigmas) if sigmas else roi_assemble(tiles, asked)
        log.append(name, reliable_checkpoint(boxes.select(*TILES.fieldNames())))

    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(source)
    writer = lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
