"""Spark-native web harvest: raw page tables in, linked page/product/photo tables out."""

from weblake.config import HarvestConfig

__all__ = ["HarvestConfig"]
