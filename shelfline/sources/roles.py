"""Role views: the semantic layer every mart is written against.

A mart never names a physical table.  It asks a :class:`Roles` bundle for the
rental fact, the payment fact and the dimensions.  Providers build the bundle
from a physical schema (``testdata.py`` from the TPC-H-ish parquet files,
``jdbc.py`` from a live rental database).

Column contracts (all lazily planned DataFrames):

* ``rental``      rental_id, rental_date, return_date, inventory_id, customer_id, staff_id
* ``payment``     rental_id, amount (exact decimal; 0..n rows per rental)
* ``inventory``   inventory_id, film_id, store_id
* ``film``        film_id, title, rating, rental_rate (decimal)
* ``film_category`` film_id, category_id;  ``category`` category_id, name
* ``film_actor``  film_id, actor_id;       ``actor`` actor_id, first_name, last_name
* ``customer``    customer_id, first_name, last_name
* ``customer_country`` customer_id, country (the address -> city -> country chain)
* ``staff``       staff_id, first_name, last_name
* ``stores``      store_id (every store, also those without rentals)
* ``activity``    ts, customer_id, amount, rows: timestamped transactions carrying
                  a real time of day (hour patterns); ``rows`` is what joining the
                  payments makes of one, greatest(#payments, 1)
* ``activity_store`` the same with store_id, read only when a store is asked for
* ``conversations`` conv_id, turn, role, text

``rental_id`` may be any equality-comparable type (a struct in the test-data
provider, to stay overflow-free at large scale).

Optional, for providers that can derive it more cheaply than the generic plan:

* ``rental_paid`` rental ⋈ inventory ⟕ payment already reduced to one row per
  rental: the rental columns plus film_id, store_id, ``paid`` (sum of its
  payments, null if none) and ``rows`` (rows the payment join produces,
  greatest(#payments, 1)) and, where keys may repeat, ``rental_first``, true on one
  row of each rental key.  ``rental_paid_complete`` states that every rental
  has its inventory unit, so the frame also stands for rental ⟕ payment.
* ``film_category_named`` film_category ⋈ category as (film_id, name).
* ``rental_cells``, ``rental_sketches``, ``activity_cells``: stored aggregates by store and month
  (see :mod:`shelfline.operators.cells`); ``rental_paid`` then has a partition column ``rental_month``.
* ``signature``: a digest of all input files the views were planned on.
* ``units_keyed``: true where no two rows of ``inventory`` share their inventory_id, ``film_id`` and ``store_id`` of
  ``rental_paid`` are those of the unit, and every unit of ``rental_paid`` that has a store is in ``inventory``.

An optional field may hold a :class:`Deferred`: what it builds is built when a mart first reads the field, so a mart
that needs no fact waits for none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame


class Deferred:
    """A value that is built with its first use and kept."""

    def __init__(self, build: Callable[[], object]) -> None:
        self.build = build

    @cached_property
    def value(self) -> object:
        return self.build()


@dataclass(frozen=True)
class Roles:
    rental: DataFrame
    payment: DataFrame
    inventory: DataFrame
    film: DataFrame
    film_category: DataFrame
    category: DataFrame
    film_actor: DataFrame
    actor: DataFrame
    customer: DataFrame
    customer_country: DataFrame
    staff: DataFrame
    stores: DataFrame
    activity: DataFrame
    conversations: DataFrame
    activity_store: DataFrame | None = None
    rental_paid: DataFrame | None = None
    rental_paid_complete: bool = False
    film_category_named: DataFrame | None = None
    rental_cells: DataFrame | None = None
    rental_sketches: DataFrame | None = None
    activity_cells: DataFrame | None = None
    signature: str | None = None
    units_keyed: bool = False

    def __getattribute__(self, name: str):
        found = object.__getattribute__(self, name)
        return found.value if isinstance(found, Deferred) else found
