"""What several tests share."""

import os

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
