import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from checks.compare import session

    spark = session()
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def parse_text(spark):
    """Parsed files of one or more diff texts, as change sets 0, 1, …"""
    from changelens.operators.parse import parse_files

    def parse(*texts):
        rows = [(i, 0, "main", t) for i, t in enumerate(texts)]
        return parse_files(
            spark.createDataFrame(rows, "change_id bigint, part_idx bigint, base_branch string, diff_text string")
        )

    return parse
