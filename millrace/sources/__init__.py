"""Tables, point stores, objects, imports and exports."""
