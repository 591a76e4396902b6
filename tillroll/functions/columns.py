"""Column names, schemas and fixed values of the order-line model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class LineColumns:
    """Names of the order-line columns; pass another instance to run on other tables."""

    invoice: str = "invoice"
    stock_code: str = "stock_code"
    description: str = "description"
    quantity: str = "quantity"
    invoice_date: str = "invoice_date"
    price: str = "price"
    customer_id: str = "customer_id"
    country: str = "country"
    source: str = "source_period"
    cancelled: str = "is_cancelled"
    negative: str = "is_negative_quantity"
    service: str = "is_service"
    line_total: str = "line_total"

    @property
    def raw(self) -> list[str]:
        return [
            self.invoice, self.stock_code, self.description, self.quantity, self.invoice_date,
            self.price, self.customer_id, self.country, self.source,
        ]


RETAIL = LineColumns()

MONEY = T.DecimalType(18, 4)

# Fixed value: stock codes that are postage, fees, corrections or tests rather than goods.
SERVICE_CODES = (
    "M", "POST", "DOT", "C2", "D", "BANK CHARGES", "AMAZONFEE", "B", "CRUK", "S", "PADS", "TEST001", "TEST002",
)

# Fixed value: headers of the source sheets and the names they get.
SOURCE_HEADERS = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}

RAW_TYPES = {
    "invoice": T.StringType(),
    "stock_code": T.StringType(),
    "description": T.StringType(),
    "quantity": T.IntegerType(),
    "invoice_date": T.TimestampNTZType(),
    "price": MONEY,
    "customer_id": T.IntegerType(),
    "country": T.StringType(),
}

SOURCE_SCHEMA = T.StructType(
    [T.StructField(header, RAW_TYPES[name]) for header, name in SOURCE_HEADERS.items()]
)

# Columns, types and required fields of the entities.
ENTITY_SCHEMAS = {
    "customers": T.StructType([T.StructField("customer_id", T.IntegerType(), False)]),
    "products": T.StructType(
        [T.StructField("stock_code", T.StringType(), False), T.StructField("description", T.StringType())]
    ),
    "orders": T.StructType(
        [
            T.StructField("invoice", T.StringType(), False),
            T.StructField("customer_id", T.IntegerType()),
            T.StructField("invoice_date", T.TimestampNTZType(), False),
            T.StructField("country", T.StringType(), False),
            T.StructField("is_cancelled", T.BooleanType(), False),
        ]
    ),
    "order_items": T.StructType(
        [
            T.StructField("order_item_id", T.LongType(), False),
            T.StructField("invoice", T.StringType(), False),
            T.StructField("stock_code", T.StringType(), False),
            T.StructField("quantity", T.IntegerType(), False),
            T.StructField("price", MONEY, False),
            T.StructField("line_total", MONEY, False),
        ]
    ),
}

# Fixed value: parents before children, the order in which foreign keys can be satisfied.
LOAD_ORDER = ("customers", "products", "orders", "order_items")

PRIMARY_KEYS = {
    "customers": "customer_id", "products": "stock_code", "orders": "invoice", "order_items": "order_item_id",
}

# Declared text lengths of the entity columns.
TEXT_LENGTHS = {
    "products": {"stock_code": 30},
    "orders": {"invoice": 30, "country": 100},
    "order_items": {"invoice": 30, "stock_code": 30},
}
