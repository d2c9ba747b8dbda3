import pytest

from trolley.llm.common import Stages, ship

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture()
def stages(shipped, request):
    return Stages(shipped, request.node.name.split("[")[0])


@pytest.fixture(scope="session")
def documents(shipped):
    """Makes a documents table from (doc_id, text) or (doc_id, text, source) rows, over several partitions."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return shipped.createDataFrame(full, DOCS).repartition(parts)

    return make
