"""Named query plans over the analytics tables, each with its SQL twin."""
