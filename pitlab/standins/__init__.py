"""Research tables derived from the benchmark tables, all growing with them.

A supplier plays a listed security, an order line's price plays a trade print and a customer
plays a portfolio. ``frames`` derives the tables with Spark; ``sql`` states the same tables
as independent SQL for the oracle.
"""
