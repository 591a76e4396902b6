import datetime
import decimal
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.functions.columns import RAW_TYPES  # noqa: E402
from tillroll.operators import cleaning, entities, views  # noqa: E402
from tillroll.session import build_session  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

SF_DIR = os.environ.get("TILLROLL_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tillroll-tests-"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


# The sixteen hand-written raw lines of FIXTURES.md.
HAND = """
100|A1|RED CUP|2|2010-01-05 09:00:00|1.50|1|United Kingdom|P1
100|A1|RED CUP|2|2010-01-05 09:00:00|1.50|1|United Kingdom|P1
100| A2 | BLUE CUP |1|2010-01-05 09:01:00|4.00|1|United Kingdom|P1
101|A2|BLUE CUP|3|2010-02-10 12:30:00|4.00|1|France|P1
101|A2|BLUE CUP|3|2010-02-10 12:30:00|4.00|1|France|P2
C102|A1|RED CUP|-1|2010-02-11 10:00:00|1.50|1|United Kingdom|P1
103|POST|POSTAGE|1|2010-02-12 12:00:00|18.00|2|France|P1
103|A1|RED CUP!|10|2010-02-12 12:00:00|1.25|2|France|P1
104|A3|NULL|-5|2010-03-01 08:00:00|0.00|NULL|United Kingdom|P1
105|A4|LAMP|1|2010-03-04 15:00:00|20.00|NULL|United Kingdom|P1
106|A4|lamp|2|2010-03-04 15:00:00|20.00|3|EIRE|P1
107|B|Adjust bad debt|1|2010-03-05 10:00:00|-100.00|NULL|United Kingdom|P1
c108|A1|RED CUP|1|2010-03-06 11:00:00|1.50|2|France|P1
109|A1|RED CUP|1|2010-03-07 12:00:00|1.50|NULL|France|P1
109|A2|BLUE CUP|1|2010-03-07 12:00:00|4.00|2|France|P1
110|A5||1|2011-01-31 08:00:00|1000.00|4|EIRE|P2
"""


def _typed(line):
    invoice, code, text, quantity, at, price, customer, country, source = line.split("|")
    return (
        invoice, code, None if text == "NULL" else text, int(quantity), datetime.datetime.fromisoformat(at),
        decimal.Decimal(price), None if customer == "NULL" else int(customer), country, source,
    )


@pytest.fixture(scope="session")
def raw(spark):
    schema = T.StructType(
        [T.StructField(n, t) for n, t in RAW_TYPES.items()] + [T.StructField("source_period", T.StringType())]
    )
    return spark.createDataFrame([_typed(x) for x in HAND.strip("\n").split("\n")], schema).cache()


@pytest.fixture(scope="session")
def clean(raw):
    return cleaning.clean_lines(raw).cache()


@pytest.fixture(scope="session")
def tables(clean):
    return {name: frame.cache() for name, frame in entities.normalise(clean).items()}


@pytest.fixture(scope="session")
def sales_view(tables):
    return views.v_sales(tables["order_items"], tables["orders"], tables["products"]).cache()


@pytest.fixture(scope="session")
def receipts(sales_view):
    return views.invoice_receipts(sales_view).stored(lambda rows: rows.cache())
