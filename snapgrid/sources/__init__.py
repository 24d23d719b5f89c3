"""Reading, finding, converting and writing snapshot files."""
