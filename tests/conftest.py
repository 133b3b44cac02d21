import numpy as np
import pytest

from sparkgrid.session import local_session

SCHEMA = "img string, t int, c int, z int, y int, x int, v double"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def to_cells(spark):
    """Dense (z, y, x) arrays, by image name, to a cell table."""
    def make(**images):
        rows = []
        for name, a in images.items():
            a = np.atleast_3d(a) if np.ndim(a) == 3 else np.asarray(a, float)[None]
            rows += [(name, 0, 0, *map(int, i), float(a[i])) for i in np.ndindex(a.shape)]
        return spark.createDataFrame(rows, SCHEMA)
    return make


@pytest.fixture(scope="session")
def to_array():
    """Cell table (one image) back to a dense array."""
    def make(df, col="v"):
        rows = df.select("z", "y", "x", col).collect()
        out = np.full([max(r[i] for r in rows) + 1 for i in range(3)], np.nan)
        for r in rows:
            out[r[0], r[1], r[2]] = r[3]
        return out
    return make
