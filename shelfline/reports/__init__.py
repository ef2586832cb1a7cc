"""Text reports (R1-R10) assembled from marts as (section, rank, line) frames."""
