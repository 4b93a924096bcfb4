"""Archive members: one row per file inside a zip. An archive is the unit of parallel work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import raw_extension, traverses


def expand_archives(df: DataFrame, extensions: Sequence[str], key: str = "key", content: str = "content") -> DataFrame:
    """Members of the wanted kinds with their size and digest; ``safe`` is false for escaping paths.

    Members are read in pieces, so memory does not grow with their size. Archives come to Python a hundred at a time at
    most, not as Arrow batches of 10,000.
    """

    @F.udf("array<struct<pos:int,member:string,size:long,digest:string>>", useArrow=False)
    def members(blob):
        import hashlib
        import io
        import zipfile

        rows = []
        with zipfile.ZipFile(io.BytesIO(blob)) as archive:
            for pos, info in enumerate(archive.infolist()):
                if info.is_dir():
                    continue
                digest, size = hashlib.sha256(), 0
                with archive.open(info) as stream:
                    while piece := stream.read(1 << 20):
                        digest.update(piece)
                        size += len(piece)
                rows.append((pos, info.filename, size, digest.hexdigest()))
        return rows

    # not deterministic by name only: no later filter repeats the reading
    opened = df.select(F.col(key).cast("string").alias("key"), members.asNondeterministic()(F.col(content)).alias("_m"))
    listed = opened.select("key", F.explode("_m").alias("_m")).select("key", "_m.*")
    return (
        listed.withColumn("ext", raw_extension(F.col("member")))
        .where(F.col("ext").isin(*extensions))
        .withColumn("safe", ~traverses(F.col("member")))
    )
