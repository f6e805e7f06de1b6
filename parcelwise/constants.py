"""Fixed values of the domain. They decide results, so they are stated plainly."""

from decimal import Decimal

# --- fixed values: risk policy -------------------------------------------------
HIGH_RISK = Decimal("0.70")
MEDIUM_RISK = Decimal("0.30")

# --- fixed values: money -------------------------------------------------------
DEFAULT_PENALTY = Decimal("250")
DEFAULT_UNIT_COST = Decimal("80")
DEFAULT_RISK_THRESHOLD = Decimal("0.3")

# --- fixed values: rate card ---------------------------------------------------
MODE_BASE_COST = {
    "Standard Class": Decimal("50.00"),
    "Second Class": Decimal("80.00"),
    "First Class": Decimal("120.00"),
    "Same Day": Decimal("180.00"),
}
DEFAULT_MODE_COST = Decimal("80.00")
REGION_MULTIPLIER = {
    "Western Europe": Decimal("1.10"),
    "Central America": Decimal("0.90"),
    "South America": Decimal("0.95"),
    "Northern Europe": Decimal("1.25"),
    "Eastern Europe": Decimal("1.05"),
    "East of USA": Decimal("1.15"),
    "Eastern Asia": Decimal("1.20"),
    "Oceania": Decimal("1.30"),
}
DEFAULT_REGION_MULTIPLIER = Decimal("1.00")

# --- fixed values: the 23 order regions, blanks as they occur in the data ------
REGIONS = [
    "Canada", "Caribbean", "Central Africa", "Central America", "Central Asia",
    "East Africa", "East of USA", "Eastern Asia", "Eastern Europe", "North Africa",
    "Northern Europe", "Oceania", "South America", "South Asia", "South of  USA ",
    "Southeast Asia", "Southern Africa", "Southern Europe", "US Center ",
    "West Africa", "West Asia", "West of USA ", "Western Europe",
]

# --- fixed values: raw column names --------------------------------------------
LABEL = "Late_delivery_risk"
PROFIT_TARGET = "Order Profit Per Order"
ORDER_DATE = "order date (DateOrders)"
ORDER_ID = "Order Id"

PII_COLUMNS = [
    "Customer Fname", "Customer Lname", "Customer Street",
    "Customer Zipcode", "Customer Email", "Customer Password",
]
DELAY_LEAKAGE = ["Delivery Status", "Days for shipping (real)", "Order Status", LABEL]
PROFIT_LEAKAGE = ["Benefit per order", *DELAY_LEAKAGE]
ID_COLUMNS = [
    "Category Id", "Customer Id", "Department Id", "Order Customer Id", "Order Id",
    "Order Item Cardprod Id", "Order Item Id", "Product Card Id", "Product Category Id",
]
NOISE_COLUMNS = ["Order Zipcode", "Product Description", "Product Image"]


PROFIT_NUMERIC = [
    "Days for shipment (scheduled)", "Sales per customer", "Latitude", "Longitude",
    "Order Item Discount", "Order Item Discount Rate", "Order Item Profit Ratio",
    "Order Item Product Price", "Order Item Quantity", "Sales", "Order Item Total",
    "Product Price", "Product Status",
]
PROFIT_CATEGORICAL = [
    "Type", "Category Name", "Customer City", "Customer Country", "Customer Segment",
    "Customer State", "Department Name", "Market", "Order City", "Order Country",
    "Order Region", "Order State", "Product Name", "Shipping Mode",
]
SYNONYM_GROUPS = [
    ["Sales", "Order Item Total", "Sales per customer"],
    ["Product Price", "Order Item Product Price"],
]
MARGIN_ALLOWED = {"Order Item Profit Ratio"}
IDENTITY_CORRELATION = 0.98
LOSS_SHARE_TOLERANCE = 0.07
MEAN_SHIFT_TOLERANCE = 0.50

# --- fixed values: salts ---------------------------------------------------------
# Defaults for tests and examples; a deployment passes its own.
DELAY_SALT = "EXAMPLE_DELAY_SALT"

# --- fixed values: upload header gate --------------------------------------------
KNOWN_UPLOAD_COLUMNS = [
    "order id", "order id_hash", "order_id_hash",
    "order date (dateorders)", "order date", "order_date",
    "shipping mode", "order region", "order country", "category name",
    "customer segment", "type", "department name", "market",
    "days for shipment (scheduled)", "product price", "order item quantity",
    "order item discount rate", "order item profit ratio", "order profit per order",
    "late_delivery_risk",
]
MIN_KNOWN_COLUMNS = 3

# --- fixed values: upload aliases, target -> accepted headers, last present wins --
UPLOAD_ALIASES = {
    "order_id_hash": ["Order Id", "Order Id_hash", "order_id_hash"],
    "shipping_mode": ["Shipping Mode"],
    "order_region": ["Order Region"],
    "order_date": ["order date (DateOrders)", "Order Date", "order_date"],
    "customer_segment": ["Customer Segment"],
    "category_name": ["Category Name"],
    "market": ["Market"],
    "days_for_shipment": ["Days for shipment (scheduled)"],
    "product_price": ["Product Price", "Order Item Product Price"],
    "order_item_quantity": ["Order Item Quantity"],
    "discount_rate": ["Order Item Discount Rate"],
    "order_item_profit_ratio": ["Order Item Profit Ratio"],
    "sales": ["Sales", "Order Item Total", "Sales per customer"],
}
UPLOAD_DEFAULTS = {
    "shipping_mode": "Standard Class",
    "order_region": "Western Europe",
    "customer_segment": "Unknown",
    "category_name": "Unknown",
    "market": "Unknown",
    "discount_rate": "0.0",
}
SESSION_DEFAULTS = {
    "shipping_mode": "Standard Class",
    "order_region": "Western Europe",
    "customer_segment": "Unknown",
    "category_name": "Unknown",
    "market": "Unknown",
    "days_for_shipment": "4.0",
    "product_price": "59.99",
    "order_item_quantity": "1",
    "discount_rate": "0.0",
    "upgrade_cost": "80.0",
}

# --- fixed values: feature groups that a retraining run may leave out ------------
FEATURE_GROUPS = {
    "Shipping Mode": "Shipping Mode_",
    "Days for shipment": "Days for shipment (scheduled)",
    "Type": "Type_",
    "Order Region": "Order Region",
    "Customer Segment": "Customer Segment_",
    "Product Price": "Product Price",
    "Order Item Quantity": "Order Item Quantity",
    "Order Item Discount": "Order Item Discount Rate",
    "Profit Ratio": "Order Item Profit Ratio",
    "Order Profit": "Order Profit Per Order",
    "Department Name": "Department Name_",
    "Market": "Market_",
    "Category Name": "Category Name",
    "Order Country": "Order Country",
}

# --- fixed values: scan grids ----------------------------------------------------
# fixed values: what-if levers by the raw column they set, and the order date when none is given
LEVER_NUMBERS = {
    "product_price": "Product Price", "order_item_quantity": "Order Item Quantity", "discount_rate": "Order Item Discount Rate",
    "days_for_shipment": "Days for shipment (scheduled)",
}
LEVER_TEXTS = {
    "shipping_mode": "Shipping Mode", "customer_segment": "Customer Segment", "order_region": "Order Region",
    "category_name": "Category Name", "market": "Market",
}
DEFAULT_ORDER_DATE = "2017-06-15 12:00"
DISCOUNT_GRID = ["0.00", "0.05", "0.10", "0.15", "0.20", "0.25"]
MODE_GRID = ["Standard Class", "Second Class", "First Class", "Same Day"]
DISCOUNT_BANDS = {"low": (None, "0.10"), "mid": ("0.10", "0.25"), "high": ("0.25", None)}
HEAT_BANDS = [("0.56", "severe"), ("0.52", "high"), ("0.48", "elevated")]
MIN_GROUP_ROWS = 30
MIN_TREND_MONTHS = 3
MAX_BATCHES = 12
