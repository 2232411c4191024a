"""Forecasters. Each returns long rows (model, product_id, sis_group_id, step, y, yhat)."""
