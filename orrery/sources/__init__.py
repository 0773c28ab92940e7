"""Where data lives: files, versioned datasets, durable storage."""
