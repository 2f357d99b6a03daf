"""Query op6: all documents stored as motion-JPEG, read back, with digests and shots."""

from pyspark.sql import functions as F

from talus.llm.media import read_media, store_texts
from talus.session import table


def op6_avi_mjpeg(spark, sf_dir):
    read = read_media(store_texts(table(spark, sf_dir, "documents")))
    clip = lambda c: F.concat_ws(":", c["start_ms"].cast("string"), c["end_ms"].cast("string"), c["luma"].cast("string"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("clips", clip), ",").alias("feature"),
    )


QUERIES = {"op6_avi_mjpeg": op6_avi_mjpeg}
ORACLES: dict[str, str] = {}
