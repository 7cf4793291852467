"""What the engine reads: parsing results, drawing primitives of pages, files and logs."""
