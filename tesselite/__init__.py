"""A Spark-native engine for tiled maps of voxel worlds and the data pipelines around them."""
