"""Queries over the driver's tables: each applies one operator, with SQL that must give the same rows.

Tables stand in for the domain's: customer for companies, orders for leads, lineitem for observed values (order =
entity, line number = field, discount = confidence, ship date = time), supplier for sources, events for usage and
tasks, pages for fetched pages, part for places.
"""
