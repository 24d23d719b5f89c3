"""DataFrame-to-DataFrame operators over a status history.

``status`` has one row per (station_id, fetched_at); the column names are the
canonical ones of :mod:`snapgrid.schema`.  Every operator is lazy.
"""
