"""pagelake: batch and streaming jobs over tables of pages, text regions and texts."""
