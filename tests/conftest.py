import pytest

from packlens.session import build_session

BLOCK = ("image_id string, image_type string, image_seq int, scan_id string, block_id string, block_order int, "
         "text string, confidence double, x1 int, y1 int, x2 int, y2 int")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", cores=8, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_blocks(spark):
    """Blocks from {(image, panel): [(id, text, conf, x1, y1, x2, y2), ...]}; all images are one scan."""

    def build(images, scan="s1"):
        rows = [
            (image, panel, seq, scan, f"{image}.{b[0]}", order, *b[1:])
            for seq, ((image, panel), blocks) in enumerate(images.items()) for order, b in enumerate(blocks)
        ]
        return spark.createDataFrame(rows, BLOCK)

    return build
